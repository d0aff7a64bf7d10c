import gzip
import io
from types import SimpleNamespace

import pytest

from edgetables import read_edge_list, read_graph_catalog, read_runs, write_edge_list, write_runs
from edgetables.plans.storage import checkpoint_root
from edgetables.sources import files
from edgetables.sources.edge_lists import edges_from, read_graph_meta

TEXT = "# graph_type: chain\n# n_nodes: 3\n\n1 2\n \t2   3 9\n-4\t5\n   \n#x\n"


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_edge_list_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    assert pairs(read_edge_list(spark, str(tmp_path / "a.txt"))) == [(-4, 5), (1, 2), (2, 3)]


def test_malformed_lines_raise_or_drop(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\nbad x\n7\n99999999999999999999 1\n3 4\n")
    path = str(tmp_path / "a.txt")
    assert pairs(read_edge_list(spark, path, mode="dropmalformed")) == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="not an edge"):
        read_edge_list(spark, path).count()
    with pytest.raises(ValueError):
        read_edge_list(spark, path, mode="permissive")


def test_gzip_is_spread(spark, tmp_path):
    with gzip.open(tmp_path / "web.txt.gz", "wt") as out:
        out.write("# FromNodeId\tToNodeId\n" + "".join(f"{i}\t{i + 1}\n" for i in range(500)))
    frame = read_edge_list(spark, str(tmp_path / "web.txt.gz"), partitions=3)
    assert frame.rdd.getNumPartitions() == 3
    assert pairs(frame) == [(i, i + 1) for i in range(500)]
    assert read_edge_list(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_edge_list_and_meta_round_trip(spark, edges, tmp_path):
    frame = edges([(1, 2), (3, -4)])
    path = str(tmp_path / "g")
    write_edge_list(frame, path, {"graph_type": "star", "n_nodes": 4, "n_edges": 2})
    assert pairs(read_edge_list(spark, path)) == [(1, 2), (3, -4)]
    assert tuple(read_graph_meta(spark, f"{tmp_path}/*.meta").first()) == (path, "star", 4, 2, -1, -1)


def test_catalog_defaults_and_unknown_keys(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# graph_type: fixed_diameter\n# n_nodes: 10\n# n_edges: 9\n# n_components: 1\n"
                                    "# diameter: 4\n# colour: red\n# note: a: b\n0 1\n")
    (tmp_path / "b.txt").write_text("0 1\n")
    rows = {r["path"][-5:]: tuple(r)[1:] for r in read_graph_catalog(spark, f"{tmp_path}/*.txt").collect()}
    assert rows == {"a.txt": ("fixed_diameter", 10, 9, 1, 4), "b.txt": ("unknown", 0, 0, -1, -1)}


def test_catalog_takes_metadata_tables_first(spark, edges, tmp_path):
    write_edge_list(edges([(1, 2)]).coalesce(1), str(tmp_path / "g" / "a"), {"graph_type": "star", "n_nodes": 2})
    (tmp_path / "g" / "b").mkdir()
    (tmp_path / "g" / "b" / "part.txt").write_text("# graph_type: chain\n1 2\n")
    rows = read_graph_catalog(spark, f"{tmp_path}/g/*/*.txt", f"{tmp_path}/g/*.meta").collect()
    assert sorted((r["graph_type"], r["n_nodes"]) for r in rows) == [("chain", 0), ("star", 2)]
    only = read_graph_catalog(spark, f"{tmp_path}/g/a/*.txt", f"{tmp_path}/g/*.meta").collect()
    assert [r["graph_type"] for r in only] == ["star"]


def test_catalog_reads_the_tops_of_files(spark, tmp_path):
    (tmp_path / "big file é.txt").write_text("\n# graph_type: web\n#n_nodes:7\n \n#\n" + "1 2\n" * 10_000_000 + "# n_edges: 5\n")
    with gzip.open(tmp_path / "packed.txt.gz", "wt") as out:
        out.write("# n_nodes: 4\r\n# n_nodes: 30\r\n# graph_type: x: y\r\n1 2\r\n# diameter: 3\r\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "comments.txt").write_text("# a\n# diameter: 9\n# " + "x" * 3_000_000 + "\n# n_edges: 8\n# n_nodes: many")
    (tmp_path / "one line.txt").write_text("9" * 5_000_000)
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe\n# n_nodes: 3\n")
    top = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in read_graph_catalog(spark, str(tmp_path)).collect()}
    assert top == {
        "big%20file%20é.txt": ("web", 7, 0, -1, -1),
        "packed.txt.gz": ("unknown", 4, 0, -1, -1),
        "comments.txt": ("unknown", 0, 8, -1, 9),
        "one%20line.txt": ("unknown", 0, 0, -1, -1),
        "odd.txt": ("unknown", 0, 0, -1, -1),
    }
    everywhere = read_graph_catalog(spark, f"{tmp_path}/[bp]*", headers="anywhere").collect()
    assert sorted(tuple(r)[1:] for r in everywhere) == [("unknown", 4, 0, -1, 3), ("web", 7, 5, -1, -1)]
    with pytest.raises(ValueError):
        read_graph_catalog(spark, str(tmp_path), headers="all")


def test_a_header_costs_its_first_bytes(tmp_path):
    (tmp_path / "g.txt").write_text("# n_nodes: 7\n" + "1 2\n" * 1_000_000)
    with open(tmp_path / "g.txt", "rb", buffering=0) as raw:
        buffered = io.BufferedReader(raw, files.READ_BYTES)
        text = io.TextIOWrapper(buffered)
        assert files.header_entries(text) == {"n_nodes": "7"}
        assert raw.tell() <= files.READ_BYTES


@pytest.mark.parametrize("path, place", [
    ("s3a://bucket/a/b c.txt", ("s3", "bucket", "/a/b c.txt")),
    ("s3n://bucket/a", ("s3", "bucket", "/a")),
    ("s3://bucket/", ("s3", "bucket", "/")),
    ("hdfs://name:8020/x/y", ("hdfs", "name:8020", "/x/y")),
    ("hdfs:/x", ("hdfs", "", "/x")),
    ("file:/tmp/x", ("file", "", "/tmp/x")),
    ("file:///tmp/x#1%", ("file", "", "/tmp/x#1%")),
    ("/tmp/x", ("file", "", "/tmp/x")),
    ("gs://b/x", ("gs", "b", "/x")),
    ("abfss://c@account.dfs.core.windows.net/x", ("abfss", "c@account.dfs.core.windows.net", "/x")),
])
def test_paths_as_arrow_wants_them(path, place):
    assert files.arrow_location(path) == place


def test_edges_from_reads_two_columns_only(spark, tmp_path):
    spark.range(5).selectExpr("id", "id + 1 as b", "'x' as c").write.parquet(str(tmp_path / "t"))
    frame = edges_from(spark.read.parquet(str(tmp_path / "t")), "id", "b", dst_offset=100)
    assert pairs(frame)[0] == (0, 101)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan


OLD = "algo,graph_type,n_nodes,n_edges,n_components,median_time_s,mean_time_s,stdev_time_s,successful_runs," \
      "timeout_runs,n_runs,timed_out,error\ndf,chain,10,9,1,1.5,1.6,0.1,3,0,3,0,0\n"


def test_run_tables_of_both_forms(spark, tmp_path):
    (tmp_path / "old.csv").write_text(OLD)
    old = read_runs(spark, str(tmp_path / "old.csv"))
    row = old.first()
    assert (row["algo"], row["n_nodes"], row["median_time_s"], row["diameter"], row["iterations"]) == ("df", 10, 1.5, None, None)
    write_runs(old.fillna({"diameter": 9, "iterations": 6}), str(tmp_path / "new"))
    row = read_runs(spark, str(tmp_path / "new")).first()
    assert (row["diameter"], row["iterations"], row["n_runs"]) == (9, 6, 3)
    (tmp_path / "bad.csv").write_text("algo,n_nodes\nx,1\n")
    with pytest.raises(ValueError, match="graph_type"):
        read_runs(spark, str(tmp_path / "bad.csv"))


def session_like(setting=None, context_dir=None):
    context = SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=lambda key: setting if key == "spark.checkpoint.dir" else None),
        getCheckpointDir=lambda: context_dir,
    )
    conf = {"spark.sql.warehouse.dir": "s3a://shared/warehouse/"}
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_root(session_like("s3a://shared/cp")) == "s3a://shared/cp"
    assert checkpoint_root(session_like(None, "hdfs://cp/1")) == "hdfs://cp/1"
    assert checkpoint_root(session_like()) == "s3a://shared/warehouse/.edgetables"


def test_run_tables_with_different_headers_side_by_side(spark, tmp_path):
    (tmp_path / "old.csv").write_text(OLD)
    new = OLD.replace("n_components,", "n_components,diameter,").replace("10,9,1,", "10,9,1,9,")
    (tmp_path / "new.csv").write_text(new)
    rows = read_runs(spark, str(tmp_path)).collect()
    assert sorted((r["diameter"] or 0, r["n_nodes"], r["median_time_s"]) for r in rows) == [(0, 10, 1.5), (9, 10, 1.5)]
    (tmp_path / "none.csv").write_text("df,chain,10\n")
    with pytest.raises(Exception, match="no header line"):
        read_runs(spark, str(tmp_path)).collect()


def test_ids_of_two_sides_never_meet(spark):
    frame = spark.createDataFrame([(5, 5), (-3, 2**40)], "a long, b long")
    assert pairs(edges_from(frame, "a", "b", two_sided=True)) == [(-6, 2**41 + 1), (10, 11)]
