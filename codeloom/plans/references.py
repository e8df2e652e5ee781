"""Problem 1: references of the chat and folder tables that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import micros
from codeloom.operators.orphans import Parent, Reference, find_orphans, orphan_report
from codeloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    ms = lambda c: F.col(c) * 1000
    sessions, folders = t("chat_sessions"), t("folders")
    parents = [
        Parent("users", t("users"), "id", ms("created_at"), ms("updated_at")),
        Parent("chat_sessions", sessions, "id", ms("created_at"), ms("updated_at")),
        Parent("folders", folders, "id", micros("created_at"), micros("updated_at"), scope="repo_name"),
    ]
    references = [
        Reference("chat_sessions", "users", sessions, "user_id", "id", ms("created_at")),
        Reference("active_sessions", "chat_sessions", t("active_sessions"), "session_id", "user_id", micros("updated_at")),
        Reference("document_folders", "folders", t("document_folders"), "folder_id", "doc_name", micros("moved_at")),
    ]
    return find_orphans(references, parents, t("deletion_log"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p1_found(spark, sf_dir))


_ID = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"


def _case(table_name: str, entity: str, key: str, row_key: str, own: str, created: str, updated: str, scoped: bool) -> str:
    k, same = _ID.format(f"r.{key}"), "and p.repo_name = r.repo_name" if scoped else ""
    return f"""
    select '{table_name}' ref_table, repo_name, row_key,
           case when dels is not null and (upd is null or dels > upd) then 'deleted'
                when made is null then 'missing' when made > own then 'late' end reason,
           strftime(own, '%Y-%m') period
    from (select r.repo_name, r.{row_key} row_key, {own} own, d.dels, p.upd, s.made
          from {table_name} r
          left join (select {_ID.format('record_id')} k, max(deleted_at) dels from deletion_log where lower(trim(entity)) = '{entity}' group by 1) d on d.k = {k}
          left join (select {_ID.format('id')} k, max({updated}) upd from {entity} group by 1) p on p.k = {k}
          left join (select {_ID.format('id')} k, {'repo_name,' if scoped else ''} min({created}) made from {entity} p group by all) s
                 on s.k = {k} {same.replace('p.', 's.')}
          where {k} is not null)"""


_P1 = " union ".join(
    f"select * from ({_case(*a)}) where reason is not null"
    for a in (
        ("chat_sessions", "users", "user_id", "id", "epoch_ms(r.created_at)", "epoch_ms(created_at)", "epoch_ms(updated_at)", False),
        ("active_sessions", "chat_sessions", "session_id", "user_id", "r.updated_at", "epoch_ms(created_at)", "epoch_ms(updated_at)", False),
        ("document_folders", "folders", "folder_id", "doc_name", "r.moved_at", "created_at", "updated_at", True),
    )
)

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _P1,
    "p1_report": f"select ref_table, period, reason, count(*) n_rows from ({_P1}) group by all",
}
