"""BPE encoding, decoding and counting against the tokenizers library; packing."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(WORD))
with open(public_tokenizers.path(WORD), encoding="utf-8") as f:
    MODEL = bpe.Model(f.read())


def mine(text):
    out = []
    for special, part in MODEL.segments(text):
        out += [MODEL.special[part]] if special else [i for w in MODEL.split(part) for i in bpe.encode_word(MODEL, w)]
    return out


def count(text):
    return sum(1 if special else sum(map(MODEL.count, MODEL.split(part))) for special, part in MODEL.segments(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinrth'stΣσİß \n.!12½<|>漢🙂"), st.characters(codec="utf-8")), max_size=60))
def test_ids_decode_and_count_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert mine(text) == want and count(text) == len(want)
    assert bpe.decode(MODEL, want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "Straße ", "漢字", " 🙂", "<|", "|>", "in the end", "\n\n"]), max_size=12), st.integers(1, 5))
def test_decoding_in_pieces_equals_the_library(parts, size):
    ids = LIBRARY.encode("".join(parts), add_special_tokens=False).ids
    machine = bpe.Decoder(MODEL)
    pieces = [machine.feed(ids[a : a + size]) for a in range(0, len(ids), size)]
    assert "".join(pieces) + machine.finish() == LIBRARY.decode(ids, skip_special_tokens=False)
    assert mine("".join(parts)) == ids


def test_the_query_equals_the_library(spark):
    texts = ["".join(random.Random(k).choice(["<|endoftext|>", "Ein Wort ", "日本", "a b", "é", "<|", "12 "]) for _ in range(40)) for k in range(30)] + [None, ""]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]), WORD).collect()}
    for k, t in enumerate(texts):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == want and got[k].decoded == LIBRARY.decode(want, skip_special_tokens=False)


def test_special_strings_of_any_spelling():
    import json

    with open(public_tokenizers.path(WORD), encoding="utf-8") as f:
        spec = json.load(f)
    own = {"id": 60000, "content": "[SEP]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] = [own]
    model = bpe.Model(json.dumps(spec))
    assert [s for s in model.segments("a[SEP]b")] == [(False, "a"), (True, "[SEP]"), (False, "b")]


def test_special_strings_and_very_long_words():
    rng = random.Random(5)
    for text in ("a<|endoftext|>b<|startoftext|>", "a" * 4000, "in" * 3000 + "x", "".join(rng.choice("inthear") for _ in range(9000))):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert mine(text) == want and count(text) == len(want)


def test_transducer_holds_bounded_state_and_emits_early():
    machine, out, most = bpe.Transducer(MODEL), [], 0
    for s in MODEL.start("th" * 20_000):
        out += machine.feed([s])
        most = max(most, len(machine.pending))
    assert most <= 2 * MODEL.window + MODEL.longest and len(out) > 1000
    assert out + machine.finish() == LIBRARY.encode("th" * 20_000, add_special_tokens=False).ids


def test_byte_decoder_is_incremental():
    ids = LIBRARY.encode("naïve 漢字 🙂 end", add_special_tokens=False).ids
    whole = bpe.decode(MODEL, ids, surfaces=False)
    machine = bpe.Decoder(MODEL, surfaces=False)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == whole == "naïve 漢字 🙂 end "


def frame(spark, rows, schema="doc_id long, text string, extra string, ids string"):
    return spark.createDataFrame(rows, schema)


EDGES = [(1, None, "x", None), (2, "", None, "c"), (3, "word", "", "d"), (3, "word", "", "d"), (None, "a b", None, None), (4, "lorem " * 30_000, None, None)]


def test_edge_rows(spark):
    docs = frame(spark, EDGES)
    coded = sorted(bpe.encode(docs, WORD).collect(), key=repr)
    assert len(coded) == 6 and sum(r.doc_id == 3 for r in coded) == 2
    assert {len(r.ids) for r in coded if r.doc_id in (1, 2)} == {0}
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(docs, WORD).collect()}
    assert (1, 0, 0, False) in counted and any(r[0] == 4 and r[3] for r in counted)
    empty = docs.filter("false")
    assert bpe.encode(empty, WORD).count() == bpe.count_tokens(empty, WORD).count() == packing.best_fit(empty).count() == 0


def test_packing_pieces_and_places(spark):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE))
    docs = frame(spark, EDGES)
    rows = packing.best_fit(docs).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    ids = np.array(library.encode("lorem " * 30_000, add_special_tokens=False).ids + [0], "<u4")
    mine_ = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)
    assert [r.length for r in mine_[1:]] == [2048] * (len(mine_) - 1) and sum(r.length for r in mine_) == ids.size
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine_)
    with_ids = packing.pieces(docs, BYTE, with_ids=True).filter("doc_id = 4").collect()
    assert b"".join(r.ids for r in sorted(with_ids, key=lambda r: r.piece)) == ids.tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_pack_is_whole_and_near_the_bound(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.25 * -(-sum(sizes) // 100) + 1 or min(sizes) > 33


BYTES = Tokenizer.from_file(public_tokenizers.path(BYTE))
with open(public_tokenizers.path(BYTE), encoding="utf-8") as f:
    PACKED = packing.Tokenizer(f.read())


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeinr thst\n\t .!12½<|>漢🙂é'"), st.characters(codec="utf-8")), max_size=80))
def test_packed_ids_equal_the_library(text):
    assert PACKED.ids(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


def fewest(sizes, most):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for room in {f for f in free if f >= sizes[k]}:
            i = free.index(room)
            go(k + 1, [*free[:i], room - sizes[k], *free[i + 1 :]])
        go(k + 1, [*free, most - sizes[k]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=8))
def test_pack_against_all_ways(sizes):
    assert fewest(sizes, 60) <= len(packing.pack(sizes, 60)) <= fewest(sizes, 60) + 1


def test_pack_is_within_a_sequence_of_the_bound_where_small_documents_are_many():
    rng = random.Random(4)
    for _ in range(3):
        sizes = [min(2047, int(rng.lognormvariate(5.8, 1.1)) + 1) for _ in range(4000)]
        assert len(packing.pack(sizes, 2048)) <= -(-sum(sizes) // 2048) + 1


def test_local_search_empties_a_bin():
    # best fit decreasing leaves 4+4, 3+3+3 and 3; a one-for-one exchange, then a move, empty the last
    assert len(packing.pack([4, 4, 3, 3, 3, 3], 10)) == 2


def test_words_are_remembered_in_two_generations():
    made = []
    memory = bpe.Memory(lambda w: made.append(w) or len(w), most=2)
    assert [memory[w] for w in ("a", "bb", "ccc", "a")] == [1, 2, 3, 1] and made == ["a", "bb", "ccc"]
    assert array("i", [1]).itemsize == 4


def test_two_merges_of_one_token_are_refused():
    import json

    with open(public_tokenizers.path(WORD), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = [*spec["model"]["merges"], spec["model"]["merges"][0]]
    with pytest.raises(ValueError):
        bpe.Model(json.dumps(spec))


def test_every_character_beside_words():
    for a in range(0, 0x110000, 64):
        text = "".join(f"x{chr(c)}!{chr(c)}" for c in range(a, a + 64, 7) if not 0xD800 <= c < 0xE000)
        assert mine(text) == LIBRARY.encode(text, add_special_tokens=False).ids
