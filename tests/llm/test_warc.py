import bisect
import glob
import hashlib

import pytest

from scriptsieve.llm import files, warc


def rows():
    long = "x" * 200_000
    return [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", "same"), (3, None, None), (4, "u", ""), (5, "ü", "é" * 10), (6, "http://l/", long), (None, "http://n/", "same"), (None, "http://n/", "alone"), (7, "ré", "rep"), (7, "ré", "rep")]


def frame(spark):
    return spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, shard string")


def test_round_trip_and_revisits(spark, tmp_path):
    manifest = warc.write(frame(spark), f"file://{tmp_path}/w", shard_bytes=50, file_bytes=300)
    got = warc.read(manifest, f"file://{tmp_path}/w").collect()
    assert manifest.count() > 3 and len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to, r.payload) for r in (by[1] + by[9])] == [("revisit", 9, None), ("response", None, bytearray(b"same"))]
    assert by[3][0].refers_to == 4 and by[4][0].record_type == "response" and by[4][0].payload_bytes == 0
    assert by[6][0].payload_bytes == 200_000 and {r.record_type for r in by[7]} == {"response"}
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 9)]
    assert by[5][0].payload_digest == warc.base32_sha1(("é" * 10).encode()) and by[5][0].url == "ü"


def test_same_bytes_again_and_nothing_left_over(spark, tmp_path):
    found = []
    for k, n in (("a", 3), ("b", 11)):
        warc.write(frame(spark).repartition(n), f"file://{tmp_path}/{k}", shard_bytes=50)
        found.append({p.rsplit("/", 1)[1]: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{tmp_path}/{k}/*.warc.gz")})
        assert not glob.glob(f"{tmp_path}/{k}/_temporary*")
    assert found[0] == found[1] and found[0]


def test_small_payloads_stay_responses(spark, tmp_path):
    manifest = warc.write(frame(spark), f"file://{tmp_path}/w", least=5)
    assert {r.record_type for r in warc.read(manifest, f"file://{tmp_path}/w").collect() if r.payload_bytes < 5} == {"response"}


def test_damage_is_found(spark, tmp_path):
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload", b"paYload"), good[:-2]):
        with pytest.raises(ValueError):
            warc.parse(bad)
    draft = files.Draft(str(tmp_path), "x")
    draft.write(b"1")
    draft.drop()
    assert not list(tmp_path.iterdir())


def test_empty(spark, tmp_path):
    manifest = warc.write(frame(spark).limit(0), f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read(manifest, f"file://{tmp_path}/w").count() == 0


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    got = sorted(tuple(r) for r in warc.op10_warc(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    assert [tuple(r) for r in con.execute(f"select {cols} from ({warc.ORACLE}) order by 1").fetchall()] == got


@pytest.mark.parametrize("ids", [[*range(1000), 1 << 62], [-(1 << 63), *range(5, 900, 3), (1 << 63) - 1], [7] * 50 + [8] * 50, [k * k * k for k in range(400)]])
def test_shards_hold_no_more_than_asked(spark, ids):
    sizes = spark.createDataFrame([(i, 10 + i % 7) for i in ids] + [(None, 500)], "id long, size long")
    bounds = warc.shards(sizes, 100)
    assert bounds == sorted(set(bounds))
    held = {}
    for i in ids:
        held.setdefault(bisect.bisect_right(bounds, i), []).append(i)
    assert all(sum(10 + i % 7 for i in x) <= 100 or len(set(x)) == 1 for x in held.values())
    whole = [sum(10 + i % 7 for i in held[k]) for k in sorted(held)]
    assert all(a + b > 50 for a, b in zip(whole, whole[1:]))


def test_extreme_ids_and_a_long_payload(spark, tmp_path):
    rows = [(-(1 << 63), "u", "a"), ((1 << 63) - 1, "v", "a"), ((1 << 53) + 1, "w", "x" * 3_000_000), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(df, f"file://{tmp_path}/x", shard_bytes=50), f"file://{tmp_path}/x").collect()}
    assert got == {-(1 << 63): (1, "revisit", (1 << 63) - 1), (1 << 63) - 1: (1, "response", None), (1 << 53) + 1: (3_000_000, "response", None), None: (0, "response", None)}
