"""Queries over documents, embeddings, events and chat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id
from codeloom.operators import diff as D
from codeloom.operators import text as X
from codeloom.operators import vector as V
from codeloom.operators.search import matches
from codeloom.sources.tables import table
from codeloom.streaming import changes as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None, f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
    if sql:
        SQL[name] = sql


# vectors
_COS = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


def _first_vector(t: Callable[[str], DataFrame]) -> list[float]:
    return t("embeddings").orderBy("vec_id").select("embedding").first()[0]


_Q = "(select embedding from embeddings order by vec_id limit 1) q"
_query("vector_search", f"select e.vec_id, {_COS} score from embeddings e, {_Q} where e.label in (1, 2, 3) order by score desc, e.vec_id limit 10", lambda t: V.nearest(t("embeddings"), "vec_id", "embedding", _first_vector(t), 10, F.col("label").isin(1, 2, 3)))
_query("vector_search_all", f"select e.vec_id, {_COS} score from embeddings e, {_Q} order by score desc, e.vec_id limit 20", lambda t: V.nearest(t("embeddings"), "vec_id", "embedding", _first_vector(t), 20))
_query(
    "semantic_search", f"select label, max(score) score from (select e.label, round({_COS}, 3) score from embeddings e, {_Q}) group by 1 order by 2 desc, 1 limit 5",
    lambda t: t("embeddings").withColumn("q", F.array(*(F.lit(float(x)) for x in _first_vector(t)))).select("label", F.round(F.round(V.cosine(F.col("embedding"), F.col("q")), 6), 3).alias("score")).groupBy("label").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "label").limit(5),
)
_query("vector_neighbours", f"select q.vec_id as query, e.vec_id, {_COS} score from embeddings e, embeddings q where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by score desc, e.vec_id) <= 10", lambda t: V.neighbours(t("embeddings"), t("embeddings").where("vec_id % 100 = 0"), "vec_id", "embedding", 10))
_query("embed_texts", None, lambda t: V.embed(t("documents"), "doc_id", "text").select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm")))

# texts
_DOC_LINES = "case when text is null or text = '' then cast([] as varchar[]) else string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) end"
_GREP = "(?i)merge|split"
_query(
    "grep_file", f"""with d as (select doc_id, {_DOC_LINES} l from documents), h as (select doc_id, len(l) total, i n from (select doc_id, l, unnest(range(1, len(l) + 1)) i from d) where regexp_matches(l[i], '{_GREP}')),
    m as (select *, case when n - 1 > lag(n) over (partition by doc_id order by n) + 2 then 1 when lag(n) over (partition by doc_id order by n) is null then 1 else 0 end new from h), r as (select *, sum(new) over (partition by doc_id order by n) region from m)
    select doc_id, greatest(1, min(n) - 1)::int start_line, least(any_value(total), max(n) + 1)::int end_line, count(*) n_matches from r group by doc_id, region""",
    lambda t: X.grep(t("documents"), "doc_id", "text", _GREP, 1),
)
_query("grep_folder", f"select source, count(*) n_documents, sum(k)::bigint n_matches from (select source, len(list_filter({_DOC_LINES}, lambda x: regexp_matches(x, '{_GREP}'))) k from documents) where k > 0 group by 1", lambda t: (
    t("documents").select("source", F.size(F.filter(X.lines(F.col("text")), lambda x: x.rlike(_GREP))).cast("bigint").alias("k")).where("k > 0").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("k").alias("n_matches"))
))
_PATHS = r"[a-z_]+(?:/[a-z_]+)+\.(?:py|js|ts|go|java)"
_query("repo_url_extraction", f"select distinct doc_id, lower(unnest(regexp_extract_all(text, '{_PATHS}'))) mention from documents where text is not null", lambda t: X.mentions(t("documents"), "doc_id", "text", _PATHS).distinct())
# papers: documents stand for them, their first line for a title
_TITLE = "regexp_extract(text, '^[^\\n]*')"
_PAPERS = f"(select doc_id, {_TITLE} title, regexp_replace(lower({_TITLE}), '[^a-z0-9]', '', 'g') norm, source, n_chars citations, created_at from documents where text is not null)"


def _papers(t: Callable[[str], DataFrame]) -> DataFrame:
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    return t("documents").where("text is not null").select("doc_id", title.alias("title"), F.regexp_replace(F.lower(title), "[^a-z0-9]", "").alias("norm"), "source", F.col("n_chars").alias("citations"), "created_at", "text")


_query(
    "paper_search_merge", f"select doc_id, title, citations from (select * from {_PAPERS} where norm <> '' qualify row_number() over (partition by norm order by doc_id) = 1) order by citations desc nulls last, case when source = 'paper_note' then 0 else 1 end, doc_id limit 20",
    lambda t: _papers(t).where("norm <> ''").groupBy("norm").agg(F.min_by(F.struct("doc_id", "title", "citations", "source"), "doc_id").alias("v")).select("v.*").orderBy(F.col("citations").desc_nulls_last(), F.when(F.col("source") == "paper_note", 0).otherwise(1), "doc_id").limit(20).select("doc_id", "title", "citations"),
)
_query(
    "papers_in_range", f"select doc_id, citations from {_PAPERS} where created_at >= timestamp '2025-06-01' and created_at < timestamp '2025-09-01' and citations >= 500",
    lambda t: _papers(t).where("created_at >= timestamp_ntz'2025-06-01' and created_at < timestamp_ntz'2025-09-01' and citations >= 500").select("doc_id", "citations"),
)
_query(
    "local_paper_search", "select doc_id, created_at from documents where contains(lower(text), 'fingerprint') or contains(lower(text), 'manifest') order by created_at desc nulls last, doc_id limit 50",
    lambda t: t("documents").where(matches("text", "Fingerprint|manifest", "pattern")).orderBy(F.col("created_at").desc_nulls_last(), "doc_id").limit(50).select("doc_id", "created_at"),
)
_query(
    "paginate_all", "select doc_id, (select count(*) from documents) total, cast(ceil((select count(*) from documents) / 25.0) as bigint) total_pages from documents order by created_at desc nulls last, doc_id limit 25 offset 50",
    lambda t: t("documents").select("doc_id", "created_at").orderBy(F.col("created_at").desc_nulls_last(), "doc_id").offset(50).limit(25).select("doc_id").join(F.broadcast(t("documents").agg(F.count("*").alias("total")))).select("doc_id", "total", F.ceil(F.col("total") / 25.0).cast("bigint").alias("total_pages")),
)
_query(
    "missing_dates", "select d::date as day from range(timestamp '2025-01-01', timestamp '2026-07-01', interval 1 day) r(d) where d::date not in (select created_at::date from documents where created_at is not null and source = 'paper_note')",
    lambda t: t("region").limit(1).select(F.explode(F.expr("sequence(date'2025-01-01', date'2026-06-30', interval 1 day)")).alias("day")).join(t("documents").where("source = 'paper_note'").select(F.to_date("created_at").alias("day")), "day", "left_anti"),
)
_query(
    "feedback_list", "select o_orderkey, o_orderstatus, (select count(*) from orders where o_orderstatus = 'O') n_open, (select count(*) from orders) n_all from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey limit 20 offset 40",
    lambda t: (
        t("orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderstatus")
        .join(F.broadcast(t("orders").agg(F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("n_open"), F.count("*").alias("n_all"))))
    ),
)
_query(
    "tasks_recent", "select task_id from embedding_tasks where created_at >= (select max(created_at) from embedding_tasks) - 7 * 86400",
    lambda t: t("embedding_tasks").join(F.broadcast(t("embedding_tasks").agg((F.max("created_at") - 7 * 86400).alias("since")))).where("created_at >= since").select("task_id"),
)
_query(
    "task_events_since", "select event_id, event_type from events where event_id > 900 order by ts, event_id limit 100",
    lambda t: t("events").where("event_id > 900").orderBy("ts", "event_id").limit(100).select("event_id", "event_type"),
)
_ID = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_query(
    "chat_sessions_list", f"""with s as (select {_ID.format('id')} k, {_ID.format('user_id')} u, repo_name, created_at, updated_at from chat_sessions qualify row_number() over (partition by {_ID.format('id')} order by updated_at desc nulls last, created_at desc, repo_name desc, user_id desc nulls last) = 1),
    m as (select {_ID.format('session_id')} k, count(distinct id) n from chat_messages group by 1) select u as user_key, repo_name, k session_key, coalesce(n, 0) n_messages, row_number() over (partition by u, repo_name order by updated_at desc, k)::int recency from s left join m using (k) where u is not null""",
    lambda t: _sessions(t),
)


def _sessions(t: Callable[[str], DataFrame]) -> DataFrame:
    """The sessions of each user and repository, the most recent first, with their numbers of messages."""
    s = t("chat_sessions").select(norm_id("id").alias("session_key"), norm_id("user_id").alias("user_key"), "repo_name", "created_at", "updated_at", "user_id")
    s = s.groupBy("session_key").agg(F.max_by(F.struct("user_key", "repo_name", "updated_at"), F.struct("updated_at", "created_at", "repo_name", "user_id")).alias("v")).select("session_key", "v.*").where("user_key is not null")
    m = t("chat_messages").groupBy(norm_id("session_id").alias("session_key")).agg(F.countDistinct("id").alias("n"))
    w = Window.partitionBy("user_key", "repo_name").orderBy(F.desc("updated_at"), "session_key")
    rows = s.join(m, "session_key", "left")
    return rows.select("user_key", "repo_name", "session_key", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_messages"), F.row_number().over(w).alias("recency"))


# changes: events stand for them
_ACTION = "case event_type when 'signup' then 'add' when 'error' then 'delete' else 'modify' end"


def _changes(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.expr(_ACTION).alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


_query("change_merge", f"select 'u' || user_id path, max_by({_ACTION}, struct_pack(a := ts, b := event_id)) as action from events group by 1", lambda t: H.merged(_changes(t("events"))))
_query(
    "debounce", f"""with c as (select user_id % 5 project, 'u' || user_id path, {_ACTION} as action, ts, event_id from events), m as (select *, case when ts - lag(ts) over w < interval 10 minute then 0 else 1 end new from c window w as (partition by project order by ts, event_id)),
    b as (select *, sum(new) over (partition by project order by ts, event_id) g from m), s as (select project, g, min(ts) as "start", max(ts) + interval 10 minute as "end" from b group by 1, 2) select b.project, s."start", s."end", path, max_by(action, struct_pack(a := ts, b := event_id)) as action from b join s using (project, g) group by all""",
    lambda t: D.bursts(t("events").select((F.col("user_id") % 5).alias("project"), F.concat(F.lit("u"), "user_id").alias("path"), F.expr(_ACTION).alias("action"), "ts", "event_id"), "project", "path", "action", "ts", "event_id", "10 minutes"),
)


def _apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of changes, applied batch by batch; what is there in the end."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return H.live(H.run(spark, _changes(stream))).select("path", "action")


QUERIES["apply_changes"] = _apply
SQL["apply_changes"] = f"select * from (select 'u' || user_id path, max_by({_ACTION}, struct_pack(a := ts, b := event_id)) as action from events group by 1) where action <> 'delete'"
