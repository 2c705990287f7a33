"""Byte-pair encoding: a streaming transducer with bounded lookahead, a decoder that is an
incremental byte-to-text state machine, and heap-and-linked-list merging for counts.

The vocabulary is a public tokenizer file (JSON of the tokenizers library) of byte-level
BPE with a ``Split`` or no pre-tokenizer beside ``ByteLevel`` and no decoder.  The driver
reads the file and broadcasts its text, whose size is fixed, so executors need no file.

Why the transducer is right.  With each token made by one merge, a sequence of tokens is
the encoding of its text if and only if every two neighbours are the encoding of theirs.
So each prefix of a word has exactly one last token that agrees with the encoding of the
rest, and prefixes form a tree: the parent of a prefix is the prefix without its last
token.  Only prefixes no shorter than the longest token can be parents of what
follows; a boundary that all of these share is stable and its tokens are emitted.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import map_blocks, tokenizer_path

#: Words up to this length are remembered in a worker; longer ones are encoded each time.
CACHED_WORD = 48
#: Words remembered in each of two generations.
CACHE_WORDS = 400_000
#: Ids that the decoder is fed at once.
DECODED = 1 << 16
#: Neighbouring tokens whose compatibility is remembered.
PAIR_CACHE = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


#: Lower-case forms that the library knows of characters that Python's tables don't have (fixed values).
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
#: A private character, which is neither letter nor number nor space.
STAND_IN = "\ue000"


def later_letters() -> regex.Pattern:
    """Letters and numbers of the ``regex`` module that the library's older tables don't have; to it
    they are symbols.  Only characters that Python's tables lack too are asked about."""
    from tokenizers import Regex, pre_tokenizers

    free = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    asked = regex.findall(r"[\p{L}\p{N}]", free)
    classes = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), behavior="removed", invert=True)
    known = {piece for piece, _ in classes.pre_tokenize_str("".join(asked))}
    ranges: list[list[int]] = []
    for c in (ord(c) for c in asked if c not in known):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + STAND_IN + "]")


#: Characters of LATER_LOWER; and what lies beyond them all, later letters and the stand-in:
#: no later letter and no stand-in lies below this (U+0558); texts below it need no closer look.
_RAISED = regex.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")
_BEYOND = regex.compile("[^\x00-\u0557]")


class Memory(dict):
    """A bounded memo in two generations: what was used lately survives."""

    def __init__(self, make: Callable, most: int = CACHE_WORDS):
        super().__init__()
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= CACHED_WORD:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class Model:
    """Merges, vocabulary and pre-tokenization of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        of_byte = byte_symbols()
        self.inner = [self.ids[c] for c in of_byte]
        self.final = [self.ids[c + self.suffix] for c in of_byte] if self.suffix else self.inner
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = self.ids[left], self.ids[right]
            made = self.ids[left + right]
            if made in self.parts:
                raise ValueError(f"two merges make {left + right!r}; the transducer needs one merge a token")
            self.rank[pair] = (rank, made)
            self.parts[made] = pair
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in {*self.inner, *self.final}}
        for made, (left, right) in self.parts.items():
            self.symbols[made] = self.symbols[left] + self.symbols[right]
        self.longest = max(map(len, self.symbols.values()))
        self.later = later_letters()
        self.pairs: dict[int, bool] = {}
        self._decoded: dict[bool, dict[int, bytes]] = {}
        self.trie: dict = {}  # symbols from a token's end backwards; at -1 the token, or -1
        for token, symbols in self.symbols.items():
            node = self.trie
            for s in reversed(symbols):
                node = node.setdefault(s, {-1: -1})
            node[-1] = token
        self.byte_of = {c: b for b, c in enumerate(of_byte)}
        self.window = self.lookahead()

    def lookahead(self) -> int:
        """Symbols to the right of a boundary that can still move it.

        A merge (a, b) is disturbed from the right only by an earlier merge whose left
        operand is b or ends b; that one by a still earlier merge, and so on.  The
        longest such chain, in symbols, is found in one pass in merge order.
        """
        reach: dict[int, int] = {}  # by left operand, over the merges seen so far
        most = 0
        for made, (left, right) in self.parts.items():
            beyond, x = 0, right
            while True:
                beyond = max(beyond, reach.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
            here = len(self.symbols[right]) + beyond
            reach[left] = max(reach.get(left, 0), here)
            most = max(most, here)
        return most + self.longest

    # -- text to words ------------------------------------------------------------

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string): special strings are found in the raw text."""
        at = 0
        if any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                if m.start() > at:
                    yield False, text[at : m.start()]
                yield True, m.group()
                at = m.end()
        if at < len(text):
            yield False, text[at:] if at else text

    def split(self, text: str) -> list[str]:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # by character: no final form of sigma
        if _BEYOND.search(text):
            if self.lower and _RAISED.search(text):
                text = text.translate(LATER_LOWER)
            if self.later.search(text):
                kept = iter(self.later.findall(text))  # each is a symbol: found as a stand-in, then put back
                found = self.words.findall(self.later.sub(STAND_IN, text))
                return [w if STAND_IN not in w else "".join(next(kept) if c == STAND_IN else c for c in w) for w in found]
        return self.words.findall(text)

    def stream(self, word: str) -> Iterator[int]:
        """The symbols of a word, one by one."""
        raw = word.encode()
        for b in memoryview(raw)[:-1]:
            yield self.inner[b]
        if raw:
            yield self.final[raw[-1]]

    def start(self, word: str) -> list[int]:
        return list(self.stream(word))

    # -- heap and linked list -----------------------------------------------------

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Merge by popping the lowest-rank adjacent pair, leftmost first among equals.

        Returns (token or -1 at each position, next position of each): a linked list."""
        n = len(symbols)
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            r = rank.get((token[i], token[i + 1]))
            if r:
                heap.append((r[0], i, r[1], token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get((made, token[k]))
                if r:
                    heapq.heappush(heap, (r[0], i, r[1], made, token[k]))
            h = before[i]
            if h >= 0:
                r = rank.get((token[h], made))
                if r:
                    heapq.heappush(heap, (r[0], h, r[1], token[h], made))
        return token, after

    def count(self, word: str) -> int:
        """Tokens of a word: its symbols minus the merges done; no ids are made."""
        n = len(word.encode())
        if n < 2:
            return n
        return n - self.merge(self.start(word))[0].count(-1)

    def bytes_of(self, surfaces: bool) -> dict[int, bytes]:
        """The bytes that each token stands for in a decoder's output."""
        if surfaces not in self._decoded:
            self._decoded[surfaces] = {i: s.encode() if surfaces or s in self.special else self._raw(s) for i, s in self.surface.items()}
        return self._decoded[surfaces]

    def _raw(self, surface: str) -> bytes:
        ends = bool(self.suffix) and surface.endswith(self.suffix)
        body = surface[: len(surface) - len(self.suffix)] if ends else surface
        return bytes(self.byte_of[c] for c in body) + (b" " if ends else b"")

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            token, _ = self.merge([*self.symbols[left], *self.symbols[right]])
            known = [t for t in token if t >= 0] == [left, right]
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known


class Transducer:
    """Encodes the symbols of one word as they come; holds no more than the unstable part."""

    def __init__(self, model: Model):
        self.model = model
        self.pending: list[int] = []
        self.last: list[int] = [-1]  # the last token of each prefix since the stable boundary
        self.parent: list[int] = [-1]

    def feed(self, symbols: Iterable[int]) -> list[int]:
        """Take symbols; return the tokens that have become stable."""
        out: list[int] = []
        model = self.model
        trie, pairs, full = model.trie, model.pairs, 2 * model.window
        pending, last, parent = self.pending, self.last, self.parent
        for symbol in symbols:
            node = trie[symbol]
            i = len(pending)
            pending.append(symbol)
            fits, at = -1, i  # the longest token that ends here and agrees with the prefix before it
            while True:
                token = node[-1]
                if token >= 0:
                    left = last[i]
                    if left < 0 or (pairs.get(left << 20 | token) or model.compatible(left, token)):
                        fits, at = token, i
                if not i:
                    break
                i -= 1
                node = node.get(pending[i])
                if node is None:
                    break
            if fits < 0:
                raise ValueError("no token fits; the merge list isn't proper")
            last.append(fits)
            parent.append(at)
            if len(pending) >= full:
                out += self._stable()
                pending, last, parent = self.pending, self.last, self.parent
        return out

    def _stable(self) -> list[int]:
        n = len(self.pending)
        live = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            live.add(max(self.parent[i], 0))
        (cut,) = live
        if not cut:
            return []
        out = self._tokens(cut)
        keep = self.last[cut]
        self.pending = self.pending[cut:]
        self.last = [keep, *self.last[cut + 1 :]]
        self.parent = [-1, *(p - cut for p in self.parent[cut + 1 :])]
        return out

    def _tokens(self, i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(self.last[i])
            i = self.parent[i]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._tokens(len(self.pending))


def encode_word(model: Model, word: str) -> list[int]:
    machine = Transducer(model)
    out = machine.feed(model.stream(word))
    return out + machine.finish() if out else machine.finish()


class Decoder:
    """Ids to text, piece by piece: a byte-to-text state machine that holds at most the
    bytes of one unfinished character, and whether a token came before.

    Every token stands for some bytes, and the incremental decoder turns bytes into text as soon as
    characters are whole.  Without a decoder in its file the library writes the tokens' surfaces with a
    space between them; that is ``surfaces=True``.  Otherwise the bytes are those that the tokens
    were made from, with a space where a word ends.
    """

    def __init__(self, model: Model, surfaces: bool = True):
        self._bytes = model.bytes_of(surfaces)
        self._between = b" " if surfaces else b""
        self._text = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def feed(self, ids: Iterable[int]) -> str:
        known = self._bytes
        raw = self._between.join([known[i] for i in ids if i in known])
        if self._begun and raw:
            raw = self._between + raw
        self._begun = self._begun or bool(raw)
        return self._text.decode(raw)

    def finish(self) -> str:
        return self._text.decode(b"", True)


def decode(model: Model, ids: np.ndarray | list[int], surfaces: bool = True) -> str:
    """The text of ids, fed in pieces of DECODED."""
    machine = Decoder(model, surfaces)
    pieces = [machine.feed(ids[a : a + DECODED]) for a in range(0, len(ids), DECODED)]
    return "".join([*pieces, machine.finish()])


#: Of the file that this worker process used last: the model and its memories of words.
_worker: dict = {}


def _known(shared, kind: str, make: Callable[[Model, str], object]) -> tuple[Model, Memory]:
    """The model of a broadcast file and a memory of words, kept between a worker's tasks."""
    if _worker.get("id") != shared.id:
        _worker.clear()
        _worker.update(id=shared.id, model=Model(shared.value))
    model = _worker["model"]
    if kind not in _worker:
        _worker[kind] = Memory(lambda word: make(model, word))
    return model, _worker[kind]


def _coded(model: Model, word: str) -> bytes:
    return array("i", encode_word(model, word)).tobytes()


class _Shared:
    """A tokenizer file's text as a broadcast."""

    def __init__(self, df: DataFrame, tokenizer: str):
        with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
            text = f.read()
        self._broadcast = df.sparkSession.sparkContext.broadcast(text)
        self.id = hash(text)

    @property
    def value(self) -> str:
        return self._broadcast.value


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): one row for each input row.

    Ids as the tokenizers library gives them without added special tokens; special strings
    inside texts are special tokens.  ``decoded`` is the library's text of these ids.  Null and empty
    texts have no ids and an empty text; rows of equal ids or texts each keep their row;
    a null id is kept; no rows give no rows; other columns are ignored.
    """
    shared = _Shared(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, known = _known(shared, "coded", _coded)
        ids, sizes, decoded = [], [0], []
        for text in batch.column("t").to_pylist():
            coded = []
            for is_special, part in model.segments(text or ""):
                if is_special:
                    coded.append(array("i", [model.special[part]]).tobytes())
                else:
                    coded += map(known.__getitem__, model.split(part))
            row = array("i", b"".join(coded))
            ids.append(row)
            sizes.append(sizes[-1] + len(row))
            decoded.append(decode(model, row))
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("i"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return map_blocks(source, run, f"doc_id {kind}, ids array<int>, decoded string", "t")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each input row.

    Null and empty texts count zero; rows of equal ids or texts each keep their row; a null
    id is kept; no rows give no rows; other columns are ignored.
    """
    shared = _Shared(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, memory = _known(shared, "counts", Model.count)
        known = memory.__getitem__
        counts = [
            sum(1 if is_special else sum(map(known, model.split(part))) for is_special, part in model.segments(text or ""))
            for text in batch.column("t").to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column("i"), batch.column("b"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), size.alias("b"))
    counted = map_blocks(source, run, f"doc_id {kind}, n_bytes long, n_tokens long", "t")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
