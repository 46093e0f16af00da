import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import helpers
from zonewalk.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = 50256


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab \n\t'stmd.,1é 中"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    library, own = Tokenizer.from_file(PATH) if not hasattr(test_any_text_is_encoded_as_the_library_does, "t") else test_any_text_is_encoded_as_the_library_does.t, bpe.vocabulary(PATH)
    test_any_text_is_encoded_as_the_library_does.t = library
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids).decode() == text


def test_digests(spark, library):
    got = {r.doc_id: r for r in bpe.encode_digests(helpers.documents(spark), PATH).collect()}
    for i, t, *_ in helpers.rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(helpers.empty(spark), PATH).count() == 0


def test_round_trip_of_id_arrays(spark):
    back = bpe.decode_ids(bpe.encode_ids(helpers.documents(spark), PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t, *_ in helpers.rows()}


def test_document_counts(spark, library):
    library.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(helpers.documents(spark), PATH, END).collect()}
    library_counts = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in helpers.rows()}
    library.encode_special_tokens = False
    assert got == library_counts
    assert token_counts.document_counts(helpers.empty(spark), PATH, END).count() == 0


@pytest.mark.parametrize("block, scan", [(1, 2), (3, 1), (7, 4096)])
def test_counts_across_blocks(spark, monkeypatch, tmp_path, block, scan):
    monkeypatch.setattr(token_counts, "SCAN_BLOCKS", scan)
    rng, want = np.random.default_rng(block), {}
    for name in ("a", "b", "c"):
        lengths = rng.integers(0, 12, 15).tolist() if name != "c" else []
        tail = {"a": 0, "b": 4, "c": 3}[name]  # an open document at the end
        stream = [x for n in lengths for x in [1] * n + [END]] + [2] * tail
        (tmp_path / name).write_bytes(np.array(stream, "<u2").tobytes())
        want |= {(name, i): n for i, n in enumerate(lengths + [tail] * bool(tail))}
    (tmp_path / "empty").write_bytes(b"")
    blocks = token_counts.read_flat(spark, str(tmp_path), block_tokens=block)
    got = {(r.file.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in token_counts.count_tokens(blocks.union(blocks.limit(2)), END).collect()}
    assert got == want


def test_wide_ids_and_torn_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(np.array([70000, END, END, 65536 + END, 3], "<u4").tobytes())
    got = {r.ordinal: r.n_tokens for r in token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path), "<u4", 2), END, "<u4").collect()}
    assert got == {0: 1, 1: 0, 2: 2}
    (tmp_path / "b").write_bytes(b"12345")
    with pytest.raises(ValueError, match="whole number"):
        token_counts.read_flat(spark, str(tmp_path), "<u4")
    assert token_counts.id_type(PATH, END) == "<u2" and token_counts.id_type(PATH, 1 << 16) == "<u4"


def test_documents_are_written_as_plain_files(spark, library, tmp_path):
    docs = spark.createDataFrame([(7, "one two"), (None, "three"), (7, "one two"), (8, None)], "doc_id long, text string").coalesce(1)
    runs = token_counts.write_flat(docs, PATH, END, str(tmp_path / "flat")).collect()
    data = np.fromfile(tmp_path / "flat" / runs[0].file, "<u2").tolist()
    want = [i for t in ("one two", "three", "one two", "") for i in [*library.encode(t).ids, END]]
    assert data == want and [x for r in runs for x in r.doc_ids] == [7, None, 7, 8]
    got = [(r.doc_id, r.n_tokens) for r in token_counts.document_counts(docs, PATH, END).collect()]
    assert sorted(got, key=str) == sorted([(7, 2), (None, 1), (7, 2), (8, 0)], key=str)


def brute_padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_boundaries_are_optimal(k):
    from itertools import combinations

    rng = np.random.default_rng(k)
    lengths = rng.integers(1, 40, 30)
    cells, count = np.unique(lengths, return_counts=True)
    ends = packing.boundaries(cells, count, k)
    best = min(brute_padding(lengths, [*c, cells[-1]]) for r in range(k) for c in combinations(cells[:-1].tolist(), r))
    assert len(ends) <= k and ends == sorted(ends) and brute_padding(lengths, ends) == best


def test_packing_places_every_text_once_within_the_budget(spark):
    import re

    packed = packing.pack(helpers.documents(spark), buckets=4, token_budget=500).collect()
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t, *_ in helpers.rows()}
    assert {r.doc_id: r.n_tokens for r in packed} == want
    assert len({(r.bucket, r.batch, r.place) for r in packed}) == len(packed)
    ends = sorted({(r.bucket, r.boundary) for r in packed})
    assert len(ends) == 4 and all(r.n_tokens <= r.boundary for r in packed)
    for bucket, end in ends:
        sizes = {}
        for r in packed:
            if r.bucket == bucket:
                sizes[r.batch] = sizes.get(r.batch, 0) + 1
        full = max(1, 500 // end)
        assert sorted(sizes) == list(range(len(sizes))) and all(n == full for b, n in sizes.items() if b < len(sizes) - 1)
    assert packing.pack(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4, 16])
def test_boundaries_are_optimal_for_long_texts(k):
    """Against the plain quadratic recurrence, with many lengths above 128."""
    rng = np.random.default_rng(k)
    ends, count = np.unique(np.concatenate((rng.integers(1, 5000, 300), rng.integers(1, 90, 200), [100_000])), return_counts=True)
    upto = np.concatenate(([0], np.cumsum(count)))
    best = ends * upto[1:]
    for _ in range(1, k):
        best = np.array([min([best[i]] + [best[j] + ends[i] * (upto[i + 1] - upto[j + 1]) for j in range(i)]) for i in range(len(ends))])
    found = packing.boundaries(ends, count, k)
    padded = sum(int(c) * min(e for e in found if e >= n) for n, c in zip(ends.tolist(), count.tolist()))
    assert padded == best[-1] and len(found) <= k


def test_repeated_and_missing_ids_are_packed_each(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "x y z"), (None, None)] * 9
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), buckets=2, token_budget=9).collect()
    assert len(packed) == 45 and len({(r.bucket, r.batch, r.place) for r in packed}) == 45
    assert sorted(r.n_tokens for r in packed) == sorted([3, 3, 2, 4, 1] * 9)
