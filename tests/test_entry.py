import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One query of each family; all of them are compared by scripts/compare.py.
SAMPLE = ("p1_found", "p3_found", "search_exact", "fuzzy_search", "find_calls_out", "trace_path", "dependency_tree", "package_tree", "module_info", "inherited_methods", "node_upsert", "definition_diff", "code_snippet", "vector_neighbours", "grep_file", "debounce", "apply_changes", "chat_sessions_list")


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_against_sql(spark, rows, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings users chat_sessions chat_messages active_sessions folders document_folders code_files code_contexts embedding_tasks deletion_log".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(rel.fetchall(), key=lambda t: tuple((x is not None, str(x)) for x in t))
    got = rows(entry.queries()[name](spark, SF), *(f"`{c}`" for c in cols))
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want]
