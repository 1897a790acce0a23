"""Token ids of whole texts by a tokenizer file of the tokenizers library, with a word cache.

Pre-tokenizers of the byte-level and of the word kind never join characters across certain places (before a white
space that follows a word). The texts are cut there, each distinct chunk is encoded once, and the ids are gathered
with numpy. Texts with characters on whose class regex engines differ go to the tokenizer whole. The result
equals encode() on the whole text; a test compares them.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept before the cache starts anew: entries and characters.
MAX_ENTRIES, MAX_CHARS = 1_200_000, 24_000_000
#: Slices of texts whose chunks are looked up together.
AHEAD = 2
#: Words a call of the tokenizer.
JOINED = 128
#: Before a word: a line break, written twice (texts with two white spaces in a row are cut in another way).
BREAK = "\n\n"
#: A white space run but for its last character, or a word with the white space before it.
_CHUNK = re.compile(r"\s+(?!\S)|\s?\S+")
#: Two white spaces in a row; Arrow's regular expressions know white space of ASCII only, so it is listed.
_WHITE = "".join(f"\\x{{{i:x}}}" for i in range(1 << 16) if chr(i).isspace())
_RUN = f"[{_WHITE}][{_WHITE}]"
#: Separators on which Python and the tokenizers' regex engine disagree.
_ODD = re.compile(r"[\x1c-\x1f\x85᠎​﻿]")
_EITHER = f"{_RUN}|{_ODD.pattern}"


class Encoder:
    """encode(texts) -> (ids of all texts, ids per text). kind: "byte" (a word keeps its leading space), "word"
    (white space is dropped), or "whole" (no cache, for any other tokenizer)."""

    _made: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        vocab = self.tokenizer.get_vocab()
        self.highest = max(vocab.values())
        self.edge = np.zeros(self.highest + 1, bool)
        for token, i in vocab.items():
            self.edge[i] = token.startswith("\u0120") if kind == "byte" else token.endswith("</w>")
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.mark_ids = {m: one(m)[0] for m in ".,;:!?" if len(one(m)) == 1} if kind != "whole" else {}
        self.lowers = kind == "word" and one("AZ\u00c9") == one("az\u00e9")
        self.break_id = one("\n")[0] if kind == "byte" else -1
        self._clear()

    @classmethod
    def of(cls, path: str, kind: str) -> "Encoder":
        """One encoder a process and file."""
        if (path, kind) not in cls._made:
            cls._made[path, kind] = cls(path, kind)
        return cls._made[path, kind]

    def _clear(self) -> None:
        self.after_space: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.chars = 0
        self.n = 0
        self.used = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)

    def _store(self, cache: dict[str, int], chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(chunks) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(chunks)] = lengths
        cache.update(zip(chunks, range(self.n, self.n + len(chunks))))
        self.n += len(chunks)
        self.used += len(ids)
        self.chars += sum(map(len, chunks))

    def _add(self, cache: dict[str, int], prefix: str, chunks: list[str]) -> None:
        """Words of letters go to the tokenizer in rows, for a call costs as much as some words. A word with one
        mark behind it, or a line break before it, is put together from the word's ids; the rest goes one by one."""
        if self.kind == "whole":
            return self._add_each(cache, prefix, chunks)
        words: dict[str, list[tuple[str, str, str]]] = {" ": [], "": []}  # by prefix: (chunk, word, mark)
        other = []
        simple = [c for c in chunks if c.isalpha()]
        self._add_words(cache, prefix, simple)
        for c in chunks if len(simple) < len(chunks) else ():
            if c.isalpha():
                continue
            at, body = (prefix, c) if not prefix or c[:2] != BREAK else ("", c[2:])
            word, mark = (body[:-1], body[-1]) if body[-1:] in self.mark_ids else (body, "")
            if word.isalpha() and (at == prefix or not mark):
                words[at].append((c, word, mark))
            else:
                other.append(c)
        for at, found in words.items():
            plain = cache if at == prefix else self.plain
            self._add_words(plain, at, [w for w in dict.fromkeys(w for _, w, _ in found) if w not in plain])
            made = [f for f in found if f[0] not in cache]
            if made:
                base = np.fromiter((plain[w] for _, w, _ in made), np.int64, len(made))
                self._compose(cache, [c for c, _, _ in made], base, [m for _, _, m in made], at != prefix)
        self._add_each(cache, prefix, other)

    def _add_each(self, cache: dict[str, int], prefix: str, chunks: list[str]) -> None:
        texts = [c[1:] if prefix and c[:2] == BREAK else prefix + c for c in chunks]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self._store(cache, chunks, np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got)))

    def _add_words(self, cache: dict[str, int], prefix: str, words: list[str]) -> None:
        """Rows of words; the ids are cut where a token begins (byte, after a space) or ends (word) a word, or at the
        line breaks between them (byte, without a space)."""
        breaks = self.kind == "byte" and prefix == ""
        rows = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = ["\n".join(r) if breaks else prefix + " ".join(r) for r in rows]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            if breaks:
                at = np.flatnonzero(ids == self.break_id)
                lengths, ids = np.diff(at, prepend=-1, append=len(ids)) - 1, ids[ids != self.break_id]
            else:
                at = np.flatnonzero(self.edge[ids])
                lengths = np.diff(at, append=len(ids)) if self.kind == "byte" else np.diff(at, prepend=-1)
            if len(lengths) == len(row):
                self._store(cache, row, ids, lengths)
            else:  # a letter that this tokenizer takes as a separator
                self._add_each(cache, prefix, row)

    def _compose(self, cache: dict[str, int], chunks: list[str], base: np.ndarray, marks: list[str], broken: bool) -> None:
        """Chunks of a line break (if broken), the ids at base, and a mark's id (if there is one)."""
        tail = np.fromiter((self.mark_ids.get(m, -1) for m in marks), np.int64, len(marks))
        inner = self.length[base]
        lengths = inner + broken + (tail >= 0)
        ends = np.cumsum(lengths)
        ids = np.empty(int(ends[-1]), np.int64)
        begin = ends - lengths
        if broken:
            ids[begin] = self.break_id
        offset = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
        ids[np.repeat(begin + broken, inner) + offset] = self.flat[np.repeat(self.start[base], inner) + offset]
        ids[ends[tail >= 0] - 1] = tail[tail >= 0]
        self._store(cache, chunks, ids, lengths)

    def _split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of texts without two white spaces in a row: the first chunk of each, the places of all others, and how many
        others each has. Arrow splits the texts and finds equal chunks, so that a chunk is looked up once a call."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " " + BREAK), " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = [chunks[c] for c in codes[offsets[:-1]].tolist()]
        rest = np.delete(codes, offsets[:-1])
        used = np.zeros(len(chunks), bool)
        used[rest] = True
        at = np.zeros(len(chunks), np.int64)
        at[used] = self._look_up(self.after_space, " ", [chunks[c] for c in np.flatnonzero(used).tolist()])
        counts = np.diff(offsets) - 1
        del parts, coded, offsets, codes
        pa.default_memory_pool().release_unused()  # a worker that waits keeps what the pool keeps
        return first, at[rest], counts

    def _look_up(self, cache: dict[str, int], prefix: str, chunks: list[str]) -> np.ndarray:
        got = np.fromiter(map(cache.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            self._add(cache, prefix, list(dict.fromkeys(new)))
            got[missing] = np.fromiter(map(cache.get, new), np.int64, len(new))
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._gather(*self._places(texts))

    def encode_slices(self, texts: list[str], most: int):
        """(from, to, ids of all texts, ids per text) of slices of at most `most` characters. Chunks are looked up once
        for AHEAD slices: a place is 8 bytes a chunk, whereas the ids are gathered by a slice."""
        sizes = list(map(len, texts))
        for a, b in batches(texts, sizes, AHEAD * most):
            places, n = self._places(texts[a:b])
            at = np.concatenate([[0], np.cumsum(n)])
            for c, d in batches(texts[a:b], sizes[a:b], most):
                yield a + c, a + d, *self._gather(places[at[c] : at[d]], n[c:d])

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the chunks of all texts are, and how many chunks each text has."""
        if self.n > MAX_ENTRIES or self.chars > MAX_CHARS:
            self._clear()
        plain: list[list[str]] = []
        easy: list[int] = []
        # of most texts one search tells that they have neither
        hard = pc.match_substring_regex(pa.array(texts, pa.string()), _EITHER).to_pylist() if self.kind == "byte" else repeat(True)
        for i, (t, h) in enumerate(zip(texts, hard)):
            if not h:
                plain.append([])
                easy.append(i)
            elif self.kind == "whole" or _ODD.search(t):
                plain.append([t] if t else [])
            elif self.kind == "word":
                # lower case first, so that a word has one entry; only of a sigma does lower() look at what follows
                plain.append((t if not self.lowers or "\u03a3" in t else t.lower()).split())
            else:
                plain.append(_CHUNK.findall(t))
        b, n_b = np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        if easy:
            first, b, n_b[easy] = self._split([texts[i] for i in easy])
            for i, c in zip(easy, first):
                plain[i] = [c]
        a = self._look_up(self.plain, "", list(chain.from_iterable(plain)))
        n_a = np.fromiter(map(len, plain), np.int64, len(texts))
        # a text's plain chunks come before its spaced ones
        n = n_a + n_b
        begin = np.cumsum(n) - n
        chunks = np.empty(int(n.sum()), np.int64)
        chunks[np.repeat(begin - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(a))] = a
        chunks[np.repeat(begin + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(b))] = b
        return chunks, n

    def _gather(self, chunks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum(n) - n
        lengths = self.length[chunks]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[chunks] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])
        per_text = bounds[begin + n] - bounds[begin]
        return ids, per_text


def batches(items: list, sizes: list[int], most: int):
    """Slices (from, to) of items with at most `most` in total, one item at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(items):
        yield at, len(items)
