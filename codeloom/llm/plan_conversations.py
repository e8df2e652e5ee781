"""Problem 5 over the chat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.conversations import conversations
from codeloom.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, f"{sf_dir}/chat_messages.parquet", table(spark, sf_dir, "chat_sessions"))


def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many exchanges each sound conversation has."""
    return p5_found(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n_exchanges"))


_EXCHANGES = r"""
with m as (select lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) k, id, case lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) when 'user' then 'u' when 'human' then 'u' when 'assistant' then 'a' when 'ai' then 'a' when 'bot' then 'a' when 'system' then 's' end r,
      case when created_at <= 0 then null when created_at < 100000000000 then created_at * 1000 when created_at < 100000000000000 then created_at
           when created_at < 100000000000000000 then created_at // 1000 else created_at // 1000000 end t,
      coalesce(regexp_matches(content, '[^\s\p{Z}\p{Cc}\p{Cf}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{2800}\x{fe00}-\x{fe0f}\x{034f}]'), false) seen
      from chat_messages where trim(session_id) <> ''),
o as (select k, id, max(r) r, max(t) t, bool_or(seen) seen from m group by k, id),
good as (select k from o group by k having bool_and(id is not null and r is not null and t is not null and seen)),
n as (select k, id, r, row_number() over w rn, lead(id) over w reply, lead(r) over w next_r, count(*) over (partition by k) c
      from o where r <> 's' and k in (select k from good) window w as (partition by k order by t, r <> 'u', id)),
sound as (select k from n group by k having count(*) % 2 = 0 and bool_and(r = case when rn % 2 = 1 then 'u' else 'a' end)),
s as (select lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) k, min(id) session_id from chat_sessions group by 1)
select session_id, id user_message_id, reply reply_message_id from n join sound using (k) join s using (k) where r = 'u'
"""
QUERIES = {"p5_found": p5_found, "p5_sessions": p5_sessions}
SQL = {"p5_found": _EXCHANGES, "p5_sessions": f"select session_id, count(*) n_exchanges from ({_EXCHANGES}) group by 1"}
