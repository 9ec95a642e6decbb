import hashlib
import base64
import uuid

import pytest
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, grace, warc
from helixframe.llm.shared import LOWER
from helixframe.llm.shared import shared_dir as _shared_dir


RUN = uuid.uuid4().hex


def shared_dir(spark):
    return f"{_shared_dir(spark)}/{RUN}"  # paths of an earlier session may still be there


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fold,table", [(1 << 20, 1 << 20), (300, 700), (1, 1)])
def test_groups_match_a_dictionary_and_survive_spilling(spark, odd, fold, table):
    df = odd.repartition(3)
    rows = exact_dedup.exact_groups(df, fold_bytes=fold, table_bytes=table).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)
    assert got == expected_groups([(r.doc_id, r.text) for r in odd.collect()])
    # Exactly one row of each group is kept, repeated ids or not.
    kept = {}
    for r in rows:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_drop_keeps_all_columns(odd):
    out = exact_dedup.drop_exact(odd)
    assert out.columns == odd.columns
    assert out.count() == len({(r.text or "").lower() for r in odd.collect()})


def test_empty_table(none):
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact(none).count() == 0


def test_equal_digests_of_different_contents_stay_apart(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "a")], "rid long, id long, content string")
    local = grace.folded(rows, lower=False, digest=lambda b: b"\0" * 32)
    got = grace.decided(local, table_bytes=1)
    found = {r.rid: (r.keep_rid, r.group_size) for r in got.collect()}
    assert found.pop(0, (2, 2)) == (2, 2) and found == {1: (1, 1), 2: (2, 2)}


def test_one_content_is_held_and_spilled_once(tmp_path):
    """Equal contents never make a bucket spill, and a bucket that spills for others writes them once."""
    hot, spilled = b"x" * 20_000, []
    digest = lambda b: hashlib.sha256(b).digest()
    records = [(digest(hot), hot, [k], (k, k), 2) for k in range(1000)]
    groups = list(grace._bucket(iter(records), f"file://{tmp_path}", 1 << 20, 0, 16, spilled.append))
    assert not spilled and len(groups) == 1 and (groups[0][2].best, groups[0][2].rows, len(groups[0][2].rids)) == ((999, 999), 2000, 1000)
    others = [b"%d" % k * 3000 for k in range(500)]
    mixed = [r for k, o in enumerate(others) for r in ((digest(o), o, [5000 + k], (5000 + k, 5000 + k), 1), *records[2 * k : 2 * k + 2])]
    groups = list(grace._bucket(iter(mixed), f"file://{tmp_path}", 1 << 20, 0, 16, spilled.append))
    assert len(groups) == 501 and sum(spilled) < 3 * sum(map(len, others))
    assert next(g for d, _, g in groups if d == digest(hot)).rows == 2000
    assert not any(tmp_path.iterdir())


def test_open_table_grows():
    t = grace.OpenTable(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(500)]
    first = [t.find(d, d) for d in keys]
    assert [t.find(d, d) for d in keys] == first == list(range(500))


PAGES = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "<p>y</p>"), (4, "http://a/\r\n4", None), (5, "http://b", ""), (None, "http://n", "<p>x</p>"), (6, "http://é", "ü" * 5000), (6, "http://é", "ü" * 5000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_archive_matches_brute_force(spark, pages):
    at = warc.write_archive(pages.repartition(2), f"{shared_dir(spark)}/warc-test-1", fold_bytes=64, table_bytes=64)
    got = warc.read_records(spark, at).collect()
    by = {}
    for i, _, h in PAGES:
        by.setdefault(h or "", []).append(i)
    assert len(got) == len(PAGES)
    for r in got:
        payload = next(h or "" for i, _, h in PAGES if i == r.page_id).encode()
        same = by[payload.decode()]
        top = max(i for i in same if i is not None)
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r.page_id != top:
            assert (r.record_type, r.refers_to) == ("revisit", top)
    responses = [r.page_id for r in got if r.record_type == "response"]
    assert sorted(responses) == [2, 3, 5, 6]
    assert sum(r.record_type == "revisit" and r.page_id == 6 and r.refers_to == 6 for r in got) == 1  # the repeated row


def test_small_payloads_are_never_revisits(spark, pages):
    at = warc.write_archive(pages, f"{shared_dir(spark)}/warc-test-2", min_bytes=100)
    kinds = {(r.page_id, r.record_type) for r in warc.read_records(spark, at).collect()}
    assert {k for i, k in kinds if i in (1, 2, 4, 5, None)} == {"response"}
    assert (6, "revisit") in kinds


def test_records_are_reconstructed_exactly(spark, pages):
    at = warc.write_archive(pages, f"{shared_dir(spark)}/warc-test-3")
    records = warc.reconstruct(spark, at).collect()
    assert len(records) == len(PAGES)
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        payload = body[:-4]
        assert int(fields["Content-Length"]) == len(payload)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(payload)
            page = int(fields["Page-Id"]) if "Page-Id" in fields else None
            assert payload.decode() == next(h or "" for i, _, h in PAGES if i == page)
    stored = spark.read.parquet(at.payloads).filter("payload is not null")
    assert stored.count() == 4  # each different payload once


def test_damage_is_found(spark, pages):
    at = warc.write_archive(pages, f"{shared_dir(spark)}/warc-test-4")
    bad = spark.read.parquet(at.payloads).withColumn("payload", F.when((F.col("n_bytes") == 8) & F.col("payload").isNotNull(), F.lit(warc.pack(b"<p>z</p>"))).otherwise(F.col("payload")))
    bad.write.parquet(f"{shared_dir(spark)}/warc-test-4b/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, warc.Archive(f"{shared_dir(spark)}/warc-test-4b/payloads", at.records)).collect()


def test_empty_archive(spark, pages):
    at = warc.write_archive(pages.limit(0), f"{shared_dir(spark)}/warc-test-5")
    assert warc.read_records(spark, at).count() == 0
    assert warc.reconstruct(spark, at).count() == 0
