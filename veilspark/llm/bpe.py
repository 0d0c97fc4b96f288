"""Byte-level BPE over Arrow text buffers: the ids that the tokenizers library gives, many words at a time.

Pre-tokens are cut with numpy masks; each distinct pre-token is merged once (all words of one length together, one merge
of every word per step) and remembered by its hash in a bounded cache. Rows outside the alphabet for which the masks are
proven equal to the tokenizer's own patterns, rows that hold "<|", and tokenizer files of another build go to the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textkit as K

#: Distinct pre-tokens remembered by one Python worker.
CACHE_WORDS = 600_000
#: Longer pre-tokens are given to the library one by one.
LONGEST = 40

_LETTER, _DIGIT, _OTHER, _BLANK = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[128:] = _LETTER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 13, 32]] = _BLANK
_NONE = np.int32(2**31 - 1)
_WORD = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "</w>")


def _byte_chars() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class FastBPE:
    """encode() gives ids and the number of ids of each row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [])
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and all("<|" in t["content"] for t in spec.get("added_tokens", []))
        self.word = bool(parts) and parts[0].get("pattern", {}).get("Regex") == _WORD[0] and model.get("end_of_word_suffix") == _WORD[1] and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.fast = plain and (self.word or norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"))
        if not self.fast:
            return
        vocab, chars = model["vocab"], _byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + (model.get("end_of_word_suffix") or ""), -1) for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = K.HashIndex(18)
        self.pairs.add(self._key(left, right))
        self._forget()

    def _forget(self) -> None:
        self.seen, self.pool, self.used = K.HashIndex(16), np.zeros(1 << 16, np.int32), 0
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pairs.find(self._key(a, b).ravel()).reshape(a.shape)
        return np.where(got < 0, _NONE, got)

    def _merge(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """sym: a row of ids for each word. Returns for each step the words that were done and their ids."""
        done, rows = [], np.arange(len(sym))
        rank = self._rank(sym[:, :-1], sym[:, 1:])
        while len(rows):
            if sym.shape[1] == 1:
                done.append((rows, sym))
                break
            best = rank.argmin(1)
            value = rank[np.arange(len(rows)), best]
            live = value < _NONE
            if not live.all():
                done.append((rows[~live], sym[~live]))
                rows, sym, rank, best, value = rows[live], sym[live], rank[live], best[live], value[live]
                if not len(rows):
                    break
            each, cols = np.arange(len(rows)), np.arange(sym.shape[1] - 1)
            sym = np.where(cols > best[:, None], sym[:, 1:], sym[:, :-1])
            sym[each, best] = self.merged[value]
            cols = cols[:-1]
            rank = np.where(cols >= best[:, None], rank[:, 1:], rank[:, :-1])
            k = np.flatnonzero(best > 0)
            rank[k, best[k] - 1] = self._rank(sym[k, best[k] - 1], sym[k, best[k]])
            k = np.flatnonzero(best < sym.shape[1] - 1)
            rank[k, best[k]] = self._rank(sym[k, best[k]], sym[k, best[k] + 1])
        return done

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Adds distinct pre-tokens to the cache."""
        size = ends - starts
        count = np.zeros(len(h), np.int64)
        placed: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size):
            k = np.flatnonzero(size == n)
            if n > LONGEST:
                for x in k:
                    ids = self.library.encode(bytes(data[starts[x] : ends[x]]).decode(), add_special_tokens=False).ids
                    placed.append((np.array([x]), np.array([ids], np.int32)))
                continue
            sym = self.inner[data[starts[k][:, None] + np.arange(n)]]
            sym[:, -1] = self.last[data[ends[k] - 1]]
            placed += [(k[rows], ids) for rows, ids in self._merge(sym)]
        for rows, ids in placed:
            count[rows] = ids.shape[1]
        begin = np.cumsum(count) - count + self.used
        need = self.used + int(count.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), np.int32)])
        for rows, ids in placed:
            self.pool[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        self.used = need
        self.seen.add(h)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        n, kind = len(data), _KIND[data]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        fresh = fresh[:n]
        start = fresh.copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.word:
            start |= kind == _DIGIT
        else:
            i = np.flatnonzero(start & ~fresh & (kind != _BLANK))
            i = i[kind[i - 1] == _BLANK]
            start[i - 1] = True
            start[i[data[i - 1] == 32]] = False
        q = np.flatnonzero(start & (data == 39))
        if len(q):
            wide = np.concatenate([data, np.zeros(4, np.uint8)])
            edge = np.concatenate([fresh, np.ones(4, bool)])
            a, b = wide[q + 1], np.where(edge[q + 2], 0, wide[q + 2])
            a = np.where(edge[q + 1], 0, a)
            k = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108), 2, 0))
            q, k = q[k > 0], k[k > 0]
            start[q + 1] = False
            to = q + 1 + k
            start[to[to < n]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        if self.word:
            keep = kind[s] != _BLANK
            s, e = s[keep], e[keep]
        return s, e

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that the library itself must encode."""
        ascii_ok = np.zeros(256, bool)
        ascii_ok[[9, 10, 13, *range(32, 127)]] = True
        bad = ~ascii_ok[data]
        k = np.flatnonzero(data >= 0x80)
        if len(k):
            after = np.append(data[1:], 0)
            lead = k[(data[k] == 0xC3) & (after[k] != 0x97) & (after[k] != 0xB7)]
            if not self.word:
                lead = np.concatenate([lead, k[(data[k] == 0xC4) | (data[k] == 0xC5)]])
            bad[lead] = False
            bad[lead + 1] = False
        if len(data) > 1:
            bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        total = np.concatenate([[0], np.cumsum(bad)])
        return np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of the rows of a block, number of ids of each row); nulls are empty texts."""
        for at, to, data, offsets in K.blocks(column):
            odd = self._odd_rows(data, offsets) if self.fast else np.arange(to - at)
            if not len(odd):
                yield at, *self._encode(data, offsets)
                continue
            ids, counts = (self._encode(data, offsets) if len(odd) < to - at else (np.zeros(0, np.int32), np.zeros(to - at, np.int64)))
            parts, bounds = np.split(ids, np.cumsum(counts)[:-1]), offsets
            for r in odd:
                got = self.library.encode(bytes(data[bounds[r] : bounds[r + 1]]).decode(), add_special_tokens=False).ids
                parts[r], counts[r] = np.array(got, np.int32), len(got)
            yield at, np.concatenate(parts), counts

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.word:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            lead = np.flatnonzero(data[:-1] == 0xC3) + 1
            lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
            data[lead] += 32
        s, e = self._cut(data, offsets)
        h = K.hashes(data, s, e)
        if self.seen.n > CACHE_WORDS:
            self._forget()
        slot = self.seen.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            self._learn(data, s[new[first]], e[new[first]], fresh)
            slot[new] = self.seen.find(h[new])
        count = self.count[slot]
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.pool[np.repeat(self.begin[slot] - total[:-1], count) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(s, offsets)])


_loaded: dict[str, FastBPE] = {}


def tokenizer(path: str) -> FastBPE:
    """One for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = FastBPE(path)
    return _loaded[path]
