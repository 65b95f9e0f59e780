"""Catalogue queries against their SQL on the small tables."""

import os

import duckdb
import pytest

from shapewright import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ("c_in", "c_class", "c_closed", "c_closed_inv", "c_equals", "c_less_than", "c_min_count", "c_max_count", "c_unique_lang", "c_list_structure", "c_list_elements", "c_or", "c_partition", "c_query", "s_all_subjects", "s_class", "f_filter_multi", "f_multi_component", "p_mixed", "q_not_exists", "q_optional_group", "q_path_step", "q_union_minus", "t_component_having", "t_component_pattern", "t_scope", "u_compact_syntax", "q_values", "q_subquery", "q_path_alternative", "q_path_closure", "q_bound", "q_in", "q_bind", "q_functions", "t_declared_filter", "t_declared_having", "t_declared_scope", "x_legacy")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    got = catalog.QUERIES[name](spark, FOLDER)
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_all_subjects_and_objects_of_the_whole_graph(spark):
    from shapewright.sources.graph import TripleGraph
    from shapewright.sources.relational import EX, MAPPING

    con = duckdb.connect()
    subjects = set()
    for line in MAPPING.strip().splitlines():
        table, kind, keys = [x.strip() for x in line.split(" | ")][:3]
        rows = con.execute(f"select {keys} from '{FOLDER}/{table}.parquet'").fetchall()
        subjects |= {f"<{EX}{kind}/{'-'.join(map(str, r))}>" for r in rows if None not in r}
    subjects |= {f"<{EX}cell/{a}-{b}>" for a, b in con.execute(f"select l_orderkey, l_linenumber from '{FOLDER}/lineitem.parquet'").fetchall()}
    subjects |= {f"_:p{e}" for (e,) in con.execute(f"select event_id from '{FOLDER}/events.parquet' where props is not null").fetchall()}
    got = [r["v"] for r in catalog.QUERIES["s_all_subjects"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == subjects
    got = [r["v"] for r in catalog.QUERIES["s_all_objects"](spark, FOLDER).collect()]
    facts = {r["o"] for r in TripleGraph.from_parquet(spark, FOLDER).all().select("o").collect()}
    assert len(got) == len(set(got)) and set(got) == facts
    assert {f"<{EX}order/{k}>" for (k,) in con.execute(f"select l_orderkey from '{FOLDER}/lineitem.parquet'").fetchall()} <= facts
