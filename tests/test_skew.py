"""A third of all rows in one frame, user and customer; large groups are cut into buckets and blocks."""

import shutil

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
HOT = {"lineitem": ("l_partkey", 7), "events": ("user_id", 3), "orders": ("o_custkey", 5)}
QUERIES = [
    "t1_parent_depth", "t2_attribute_alloc", "t3_self_time", "t4_call_paths", "t5_rollup_bytes", "v4_tree_closed", "f3_frame_interval",
    "f12_longest_run", "m1_rank_stats", "m9_memory_summary", "c5_path_profile", "q5_hierarchy", "q8_compare_frames", "w7_marker_streak", "w9_report_attempt",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        source = f"{SF}/{name}.parquet"
        if name not in HOT:
            shutil.copy(source, out)
            continue
        column, value = HOT[name]
        table = pq.read_table(source)
        hot = pc.if_else(pa.array([n % 3 == 0 for n in range(table.num_rows)]), pa.scalar(value, table.schema.field(column).type), table[column])
        table = table.set_column(table.schema.get_field_index(column), table.schema.field(column), hot)
        if name == "lineitem":  # distinct order keys keep the sample order total
            table = table.set_column(0, "l_orderkey", pa.array(range(table.num_rows), pa.int64()))
        pq.write_table(table, out / f"{name}.parquet")
    return str(out)


@pytest.fixture
def low_limits(spark):
    settings = {"spark.framescope.bucketRows": "100", "spark.framescope.treeBlockRows": "64"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_input_gives_whole_results(spark, folder, low_limits, name):
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) == []
