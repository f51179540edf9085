"""The registered queries and the pipeline on the smallest tables, against SQL and plain Python."""

import collections
import hashlib
import warnings
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from test_near_copies import plain_groups, plain_sets
from test_operators import plain_base, plain_components, plain_fingerprint, words
from tokenizers import Tokenizer

import corpus_pipeline
from txweave.llm import pii
from txweave.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours = queries()[name](spark, DATA).toArrow().to_pylist()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        theirs = duck.execute(oracle_sql()[name]).to_arrow_table().to_pylist()
    by_id = lambda rows: sorted((dict(sorted(r.items())) for r in rows), key=lambda r: r.get("doc_id", r.get("page_id")))
    assert by_id(ours) == by_id(theirs)


def test_simhash_query(spark, docs):
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i].text) for i in ids]
    expected = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, plain_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op5_simhash_near_dedup"](spark, DATA).collect()} == expected


def test_pii_query(spark, docs):
    for r in queries()["op6_pii"](spark, DATA).collect():
        base = plain_base(docs[r.doc_id].text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{i}:{j}" for i, k, j in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]


def test_suffix_query(spark, docs):
    raw = {i: (d.text or "").encode() for i, d in docs.items()}
    counts = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for r in queries()["op7_suffix_array_dedup"](spark, DATA).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_mixing_query(spark, docs):
    rows = queries()["op3_source_mixing"](spark, DATA).collect()
    target, taken = {}, collections.Counter()
    for r in rows:
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        target[docs[r.doc_id].source] = r.target
        taken[docs[r.doc_id].source] += r.taken
    assert len(rows) == len(docs) and sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)


def test_classifier_query(spark):
    rows = {r.doc_id: r for r in queries()["op4_quality_classifier"](spark, DATA).collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if rows[r.doc_id].held_out]
    right = sum((r.quality == 1) == (rows[r.doc_id].predicted == 1) for r in labels)
    assert all(0 <= r.score <= 1 for r in rows.values()) and right >= 0.8 * len(labels) > 0


def test_url_query(spark):
    out = queries()["op8_url_filters"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/pages.parquet").count() and out.where("verdict is null").count() == 0


def pieces_of(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
    cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
    return [(k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]


def well_placed(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_and_media_queries(spark, docs):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = queries()["op9_best_fit_packing"](spark, DATA).collect()
    well_placed(rows)
    expected = [(i, *p) for i, d in docs.items() for p in pieces_of(tokenizer, d.text or "")]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    for r in queries()["op10_media_columns"](spark, DATA).collect():
        b = (docs[r.doc_id].text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_pipeline(spark, docs):
    # So few labels and candidates that no cutoff and no added span is safe: the base rules alone decide.
    good = {}
    for i, d in docs.items():
        w = words(d.text)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        if len(w) >= 10 and 100 * len(cover) <= 20 * len(w):
            good[i] = d.text
    ids = sorted(good)
    roots = plain_groups(plain_sets([good[i] for i in ids]))
    first = [ids[r] for r in sorted(set(roots))]

    def redacted(t):
        out, at, end = [], 0, 0
        for start, kind, stop in plain_base(t):
            if start >= end:
                out += [t[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = end = max(end, stop)
        return "".join(out) + t[at:]

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, DATA).collect()
    well_placed(rows)
    found = collections.defaultdict(collections.Counter)
    for r in rows:
        found[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
    assert set(found) <= set(first)
    for i, own in found.items():
        assert set(own) == set(pieces_of(tokenizer, redacted(good[i]))) and len(set(own.values())) == 1 and set(own.values()) <= {1, 2}
    taken = sum(len(words(redacted(good[i]))) * next(iter(own.values())) for i, own in found.items())
    assert taken == pytest.approx(1.5 * sum(len(words(redacted(good[i]))) for i in first), rel=0.1)
