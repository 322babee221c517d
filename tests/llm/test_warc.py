"""Archives against a plain reader of whole files, in ranges of every size; pages against what was written."""

import base64
import glob
import hashlib
import random

import pytest
from fixtures import CLASHES, got
from pyspark.sql import functions as F

from inclina.llm import warc

SCHEMA = "page_id long, url string, html string"


def fake(body: str, length: int | None = None) -> str:
    """A record inside a payload."""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {len(body.encode()) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def pages() -> list[tuple]:
    rng = random.Random(5)
    html = [
        None, "", "<p>one</p>", "WARC/1.1\r\n", "x WARC/1.1\r\n y", "a\r\n\r\nWARC/1.1\r\n", fake("inner"), fake("two") * 3 + fake("three", 10**6), "<é漢>" * 30,
        "\r\n" * 50, "\r\n\r\n" + fake("z") + "\r\n", "end\r\n\r\n", fake("deep " + fake("deeper")) * 40, "p" * 30_000, ("q" * 700 + fake("r" * 90)) * 60,
    ]
    html += ["".join(rng.choice("ab\r\n<>") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(i, rng.choice([None, "http://a.b/c d", "http://x/WARC/1.1\r\n", f"https://e.org/{i}"]), h) for i, h in enumerate(html)]
    rows += [(1000 + i, "u", h) for i, h in enumerate(html[:16])] + [(-5, "u", html[13]), (None, "n", html[2]), (None, "n", "only here"), (2000, "u", "twice"), (2000, "u", "twice")]
    rng.shuffle(rows)
    return rows


def expected(rows: list[tuple]) -> list[tuple]:
    groups: dict[bytes, list] = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i))
        out += [(i, len(payload), digest, "response" if k == len(ids) - 1 else "revisit", None if k == len(ids) - 1 else ids[-1]) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def plain_records(folder: str) -> list[tuple]:
    """Every record of every file, read front to back."""
    out = []
    for file in glob.glob(f"{folder}/part-*"):
        data, at = open(file, "rb").read(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            head = data.index(b"\r\n\r\n", at)
            length = next(int(line.split(b":")[1]) for line in data[at:head].split(b"\r\n") if line.startswith(b"Content-Length"))
            out.append((file.rsplit("/", 1)[1], at, data[head + 4 : head + 4 + length]))
            at = head + 4 + length + 4
    return sorted(out)


def read(spark, folder: str) -> list[tuple]:
    return sorted((r["file"].rsplit("/", 1)[1], r["at"], bytes(r["block"])) for r in warc.read_archives(spark, folder).collect())


@pytest.fixture
def ranges(spark):
    """Sets the size of the ranges that files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size: int):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "files")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(2), path)
    return path


@pytest.mark.parametrize("size", [1 << 27, 50_000, 4_001, 997])
def test_records_of_any_ranges(spark, ranges, folder, size):
    ranges(size)
    assert read(spark, folder) == plain_records(folder)


def test_ranges_too_many_to_broadcast(spark, ranges, folder, monkeypatch):
    ranges(5_000)
    monkeypatch.setattr(warc, "RANGES", 0)
    assert read(spark, folder) == plain_records(folder)


def test_chain_ends_and_damage(spark, ranges, folder, tmp_path):
    ranges(3_000)
    assert all(r["whole"] for r in warc.chain_ends(spark, folder).collect())
    file = max(glob.glob(f"{folder}/part-*"), key=lambda f: len(open(f, "rb").read()))
    data, records = open(file, "rb").read(), [r for r in plain_records(folder) if r[0] == file.rsplit("/", 1)[1]]
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "part-a").write_bytes(data[:-3])  # the last record is cut off
    start = records[5][1]
    (cut / "part-b").write_bytes(data[:start] + b"junk" + data[start:])  # no record follows the fifth
    found = read(spark, str(cut))
    assert [r[1:] for r in found if r[0] == "part-a"] == [r[1:] for r in records[:-1]]
    assert [r[1:] for r in found if r[0] == "part-b"] == [r[1:] for r in records[:4]]
    assert not any(r["whole"] for r in warc.chain_ends(spark, str(cut)).collect())


@pytest.mark.parametrize("size", [1 << 27, 2_500])
def test_pages(spark, ranges, size):
    ranges(size)
    df = spark.createDataFrame(pages(), SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHES, "payload", "row", "same", "digest", "file", "at", "range"]}).repartition(3)
    found = warc.round_trip(df)
    assert got(found.drop("payload")) == expected(pages())
    payloads = {bytes(r["payload"]).decode() for r in found.where("payload IS NOT NULL").collect()}
    assert payloads == {h or "" for _, _, h in pages()}


def test_fields(spark, folder):
    rows = warc.read_archives(spark, folder).select("headers", "type").collect()
    assert {r["type"] for r in rows} == {"response", "revisit"}
    assert all(r["headers"]["warc-payload-digest"].startswith("sha1:") for r in rows)
    assert len({r["headers"]["warc-record-id"] for r in rows}) == len(rows)
    assert all((r["type"] == "revisit") == ("warc-refers-to" in r["headers"]) for r in rows)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
