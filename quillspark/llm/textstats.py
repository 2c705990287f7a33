"""Counts over words of many texts at once; a text may be a document or a line."""

from __future__ import annotations

import numpy as np

from quillspark.llm.bytespans import Rolling, Words

#: Characters that count as symbols (fixed set of the rule).
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5


def _among(raw: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[raw]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def repeated_words(words: Words, rolling: Rolling, owner: np.ndarray) -> np.ndarray:
    """Per word: whether a window of REPEAT_WINDOW words around it is found twice in its text."""
    index = np.arange(words.start.size)
    at = index[index + REPEAT_WINDOW <= words.limit]
    h = rolling.windows(at, np.full(at.size, REPEAT_WINDOW))
    order = np.lexsort((h, owner[at]))
    same = (h[order][1:] == h[order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    twice = np.zeros(at.size, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(words.start.size + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + REPEAT_WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def word_stats(texts: list[bytes | None], windows: bool = True) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, caps_words, same_words (equal to the word
    before), plain_words (letters and digits but for one mark, two beside digits), exclaims, digits, ends (a
    closing mark at the end), distinct_words and, with ``windows``, n_repeat_words."""
    w = Words(texts)
    raw = np.frombuffer(w.buf, np.uint8)
    first = w.first
    per_text = lambda flags: (s := _sums(flags))[first[1:]] - s[first[:-1]]
    n = w.start.size
    edge = np.append(w.start, raw.size)  # the byte where each word begins

    def by_word(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return s[w.end] - s[w.start] if n else np.zeros(0, np.int64)

    def by_text(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return s[edge[first[1:]]] - s[edge[first[:-1]]]

    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    more = (raw & 0xC0) == 0x80
    letter = upper | lower | (raw >= 128)
    h = w.hashes()
    owner = np.repeat(np.arange(first.size - 1), np.diff(first))
    same = np.zeros(n, bool)
    distinct = np.zeros(n, bool)
    if n:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((h, owner))
        distinct[order] = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
    up, low, let, digit = by_word(upper), by_word(lower), by_word(letter), by_word((raw >= 48) & (raw <= 57))
    marks = w.end - w.start - let - digit
    last = raw[w.end[first[1:][np.diff(first) > 0] - 1] - 1] if n else np.zeros(0, np.uint8)
    ends = np.zeros(first.size - 1, np.int64)
    ends[np.diff(first) > 0] = _among(last, b".!?:;\"')")
    out = {
        "n_words": np.diff(first),
        "word_chars": by_text(~more & (raw != 32)),
        "n_symbols": by_text(_among(raw, SYMBOLS)),
        "caps_words": per_text((up >= 2) & (low == 0)),
        "same_words": per_text(same),
        "plain_words": per_text((let + digit >= 1) & (marks <= np.where(digit >= 1, 2, 1))),
        "exclaims": by_text(raw == 33),
        "digits": by_text((raw >= 48) & (raw <= 57)),
        "ends": ends,
        "distinct_words": per_text(distinct),
    }
    if windows:
        out["n_repeat_words"] = per_text(repeated_words(w, Rolling(h), owner))
    return out


def line_counts(text: bytes | None) -> tuple[int, int]:
    r"""(\n-split lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip()] if text else []
    return len(lines), len(lines) - len(set(lines))
