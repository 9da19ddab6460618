import gzip
import hashlib
import re
import shutil

import pytest

from gleanery.llm import warc


def name(file):
    return re.sub(r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "", file.name)


@pytest.fixture
def replicas(spark, tmp_path):
    rows = [(k, f"http://x/{k}%\n", f"<p>{k}</p>\r\n\r\nWARC/1.1\r\n" * (k % 4), 0) for k in range(90)]
    rows += [(None, None, None, 0), (7, "", "", 0), (7, "", "", 0), (8, "é", "é" * 100_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, number int").coalesce(2)
    warc.write_archive(df, str(tmp_path / "a"), file_records=20)
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    return rows, tmp_path


def nodes(spark, path):
    return warc.tree(warc.read_archive(spark, str(path)))


def test_pages_read_back(spark, replicas):
    rows, path = replicas
    got = warc.read_archive(spark, str(path / "a")).collect()
    assert sorted(map(repr, [(r.page_id, r.url, r.html) for r in got])) == sorted(repr(r[:3]) for r in rows)
    assert all(r.sound for r in got)
    for f in (path / "a").glob("*.gz"):
        raw = gzip.decompress(f.read_bytes())
        mine = sorted((r for r in got if r.segment == name(f)), key=lambda r: r.number)
        assert [r.start for r in mine] == [0, *(r.end for r in mine[:-1])] and mine[-1].end == len(raw)


def test_roots_match_a_plain_tree(spark, replicas):
    _, path = replicas
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.segment: r.hash for r in nodes(spark, path / "a").where(f"level = {warc.LEVELS}").collect()}
    records = {}
    for r in warc.read_archive(spark, str(path / "a")).collect():
        records.setdefault(r.segment, []).append((r.number, sha(f"leaf|{r.sha256}|{r.start}|{r.end}"), r.start, r.end))
    for segment, level in records.items():
        level = sorted(level)
        for _ in range(warc.LEVELS):
            groups = [level[k : k + warc.FANOUT] for k in range(0, len(level), warc.FANOUT)]
            level = [(k, sha("node|" + "|".join(f"{h},{s},{e}" for _, h, s, e in g)), g[0][2], g[-1][3]) for k, g in enumerate(groups)]
        assert len(level) == 1 and got[segment] == level[0][1]


def test_audit_finds_damage_and_only_that(spark, replicas):
    _, path = replicas
    a = nodes(spark, path / "a")
    assert warc.audit(a, nodes(spark, path / "b")).count() == 0
    files = sorted((path / "b").glob("*.gz"))
    raw = bytearray(gzip.decompress(files[0].read_bytes()))
    spans = [s for s in warc.parse(bytes(raw))]
    raw[spans[5][1] - 8] ^= 1  # a byte of the sixth record's block
    files[0].write_bytes(gzip.compress(bytes(raw)))
    cut = gzip.decompress(files[1].read_bytes()).replace(b"Content-Length: ", b"Content-Length; ", 1)  # the first header
    files[1].write_bytes(gzip.compress(cut))
    files[2].write_bytes(b"not gzip")
    files[3].unlink()
    (path / "b" / ("." + files[0].name + ".crc")).unlink(missing_ok=True)
    for f in files[:4]:
        (path / "b" / f".{f.name}.crc").unlink(missing_ok=True)
    found = {}
    for r in warc.audit(a, nodes(spark, path / "b")).where("level = 0").orderBy("segment", "node").collect():
        found.setdefault(r.segment, []).append(r)
    assert [(r.node, r.start_a, r.end_a) for r in found[name(files[0])]] == [(5, spans[5][0], spans[5][1])]
    assert [r.node for r in found[name(files[1])]] == [0]
    assert [r.node for r in found[name(files[2])]] == list(range(6)) and [r.node for r in found[name(files[3])]] == list(range(20))
    assert set(found) == {name(f) for f in files[:4]}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "e"))
    assert warc.audit(nodes(spark, tmp_path / "e"), nodes(spark, tmp_path / "e")).count() == 0


def test_query(spark, sf_dir):
    rows = warc.op8_merkle_audit(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    assert all(r.intact == (r.page_id % 97 != 0) for r in rows) and not all(r.intact for r in rows)


def test_large_pages_lie_in_files_of_few_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (100, 1600))
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    html = ["x" * n for n in [*range(50), *range(200, 1500, 50), 1700, 1900, 3000, 9000]]
    warc.write_archive(spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string"), str(tmp_path / "a"), file_records=32)
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.html) for r in got) == sorted(enumerate(html))
    size = {}
    for r in got:
        size.setdefault(r.segment, []).append(r.n_bytes)
    assert all(len(s) <= (32 if max(s) <= 100 else 2 if max(s) <= 1600 else 1) for s in size.values())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1"


def test_page_ids_of_64_bits(spark, tmp_path):
    ids = [1234567890123456789, 2**63 - 1, -(2**63), -1, 10**18]
    warc.write_archive(spark.createDataFrame([(k, "u", "h") for k in ids], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert sorted(r.page_id for r in warc.read_archive(spark, str(tmp_path / "a")).collect()) == sorted(ids)


def test_records_of_either_replica_are_reported(spark, tmp_path):
    html = [f"<p>{k}</p>" for k in range(6)]
    for replica, texts in (("a", html[:5]), ("b", [*html[:2], "<p>x</p>", *html[3:]])):
        rows = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
        warc.write_archive(rows, str(tmp_path / replica))
    got = warc.audited(*(warc.read_archive(spark, str(tmp_path / r)) for r in "ab")).collect()
    assert sorted((r.page_id, r.intact) for r in got) == [(0, True), (1, True), (2, False), (3, True), (4, True), (5, False)]
