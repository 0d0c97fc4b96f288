"""Operator 4: token counts by a compiled transducer.

A sentencepiece BPE model is compiled to a deterministic transducer over characters. Its states hold, for each place at
which a longer piece may still have begun, the position in the tree of pieces, the last token before that place and the
number of tokens since; an encoding is right exactly if its neighbouring tokens are (each pair of tokens encodes to
itself), so the last token of every prefix follows from such a state alone. A transition carries the change in the number
of tokens. States are made when first met, and forgotten together once there are MOST_STATES.

No piece reaches over a place where white space begins or beside an unknown character, so texts fall into segments that
start in the same state. Equal segments are counted once. Long segments are cut into chunks. A chunk is a map from each of
its possible entry states to the exit state and the tokens in between. The possible entry states are those that a run from
a little before the chunk ends in, and the exits of the map before it; where these differ, also the ends of runs from each
of the places before the chunk at which a token may begin (texts with a period, such as rules of hyphens, keep apart for
ever what began at different places). All chunks run side by side, and equal chunks are one. Once every exit of a map is an
entry of the next, neighbouring maps compose, in a logarithmic number of rounds, to the map of the whole segment.

Defined results: null and empty texts have no bytes and no tokens; repeated rows count each; an empty table gives no rows.
Model files of other kinds are counted by their own library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import read, tidy

MOST_STATES = 250_000
MOST_SEGMENTS = 600_000
CHUNK, WARM_UP = 128, 24
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class BpeTransducer:
    """For sentencepiece BPE with byte fallback, identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(k): -sp.get_score(k) for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))}
        self.fast = self._plain(path) and sum(map(sp.is_byte, range(n))) == 256
        chars = sorted({c for p in self.pieces for c in p if c in self.pieces})
        self.space = chars.index("▁") + 1 if "▁" in chars else 0
        self.fast &= self.space > 0 and all("▁" not in p.lstrip("▁") for p in self.pieces)
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.number[32] = self.space
        self.code = K.mix(np.arange(1, len(chars) + 2, dtype=np.uint64)) | np.uint64(1)
        self.chars = ["", *chars]
        self.tree: list[dict[int, int]] = [{}]
        self.token: list[str | None] = [None]
        own = {c: k for k, c in enumerate(self.chars)}
        for p in self.pieces:
            if all(c in own for c in p) and self._alone(p):
                at = 0
                for c in p:
                    if own[c] not in self.tree[at]:
                        self.tree[at][own[c]] = len(self.tree)
                        self.tree.append({})
                        self.token.append(None)
                    at = self.tree[at][own[c]]
                self.token[at] = p
        self.pairs: dict[tuple[str, str], bool] = {}
        self._forget()
        self.longest = max(map(len, self.pieces), default=1)
        self.known = K.HashIndex(16)
        self.counts = np.zeros(0, np.int64)

    @staticmethod
    def _plain(path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        t, norm = m.trainer_spec, m.normalizer_spec
        user = any(p.type == 4 for p in m.pieces)
        return t.model_type == 2 and t.byte_fallback and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not norm.precompiled_charsmap and not user and not t.treat_whitespace_as_suffix

    def _encode(self, parts: list[str]) -> list[str]:
        """Plain merging, for the few strings that the compiler asks about."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.pieces.get(parts[k] + parts[k + 1], np.inf))
            if parts[best] + parts[best + 1] not in self.pieces:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _alone(self, piece: str) -> bool:
        return self._encode(list(piece)) == [piece]

    def _pair(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._encode(list(a + b)) == [a, b]
        return got

    def _forget(self) -> None:
        self.states: list[tuple] = [((0, "", 0),)]
        self.number_of = {self.states[0]: 0}
        self.edges = K.HashIndex(16)
        self.to, self.emits = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _edge(self, state: int, char: int) -> tuple[int, int]:
        """state: (node, last token before, tokens since then relative to now), ...; the empty token is the start."""
        alive, last, delta = [], None, 0
        for node, before, rel in self.states[state]:
            child = self.tree[node].get(char)
            if child is not None:
                token = self.token[child]
                if token is not None and last is None and (not before or self._pair(before, token)):
                    last, delta = token, rel + 1
                if self.tree[child]:
                    alive.append((child, before, rel))
        if last is None:
            raise AssertionError("a prefix without an encoding")
        new = tuple((n, b, r - delta) for n, b, r in alive) + ((0, last, 0),)
        number = self.number_of.get(new)
        if number is None:
            number = self.number_of[new] = len(self.states)
            self.states.append(new)
        return number, delta

    def _step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = K.mix((state.astype(np.uint64) << np.uint64(16)) | char)
        slot = self.edges.find(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, first = np.unique(key[new], return_index=True)
            made = np.array([self._edge(int(state[k]), int(char[k])) for k in new[first]], np.int32)
            self.edges.add(fresh)
            self.to, self.emits = np.concatenate([self.to, made[:, 0]]), np.concatenate([self.emits, made[:, 1]])
            slot[new] = self.edges.find(key[new])
        return self.to[slot], self.emits[slot]

    def run(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of each span from its entry state."""
        order = np.argsort(starts - ends, kind="stable")
        size, at, out = (ends - starts)[order], starts[order], state[order].astype(np.int32)
        total = np.zeros(len(order), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))
            out[:m], emitted = self._step(out[:m], cls[at[:m] + k])
            total[:m] += emitted
        exits, counts = np.empty_like(out), np.empty_like(total)
        exits[order], counts[order] = out, total
        return exits, counts

    def count(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each segment, all characters known."""
        if len(self.states) > MOST_STATES:
            self._forget()
        long = np.flatnonzero(ends - starts > CHUNK)
        out = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(ends - starts <= CHUNK)
        _, out[short] = self.run(cls, starts[short], ends[short], np.zeros(len(short), np.int32))
        if len(long):
            out[long] = self._by_chunks(cls, starts[long], ends[long])
        return out

    def _by_chunks(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = -(-(ends - starts) // CHUNK)
        segment = np.repeat(np.arange(len(starts)), n)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[segment] + place * CHUNK
        end = np.minimum(begin + CHUNK, ends[segment])
        later = np.flatnonzero(place)
        guess = np.zeros(len(begin), np.int32)
        guess[later] = self._ends_of(cls, begin[later] - WARM_UP, begin[later])
        # the maps: rows (chunk, entry state, exit state, tokens), by chunk and entry
        _, alike = np.unique(K.coded(self.code[cls], begin, end), return_inverse=True)
        alike = alike.reshape(-1)
        chunk, entry = np.arange(len(begin)), guess
        exits, tokens = self._map(cls, begin, end, alike, chunk, entry)
        rounds = 0
        while True:
            onward = place[np.minimum(chunk + 1, len(place) - 1)] > 0
            onward &= chunk + 1 < len(place)
            asked = np.unique(self._pair_key(chunk[onward] + 1, exits[onward]))
            fresh = asked[~np.isin(asked, self._pair_key(chunk, entry))]
            if not len(fresh):
                break
            if rounds == 1:  # what differs has not met again within a chunk
                open_ = later[np.isin(segment[later], segment[fresh >> 32])]
                more = [self._pair_key(open_, self._ends_of(cls, begin[open_] - WARM_UP - k, begin[open_])) for k in range(1, self.longest + 1)]
                fresh = np.setdiff1d(np.concatenate([fresh, *more]), self._pair_key(chunk, entry))
            c, s = fresh >> 32, (fresh & 0xFFFFFFFF).astype(np.int32)
            x, t = self._map(cls, begin, end, alike, c, s)
            chunk, entry, exits, tokens = (np.concatenate(v) for v in ((chunk, c), (entry, s), (exits, x), (tokens, t)))
            rounds += 1
        return self._compose(segment, place, chunk, entry, exits, tokens)

    @staticmethod
    def _pair_key(chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        return (np.asarray(chunk, np.int64) << 32) | np.asarray(state, np.int64)

    def _ends_of(self, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where runs from the first state end; equal stretches run once."""
        _, one, alike = np.unique(K.coded(self.code[cls], starts, ends), return_index=True, return_inverse=True)
        return self.run(cls, starts[one], ends[one], np.zeros(len(one), np.int32))[0][alike.reshape(-1)]

    def _map(self, cls: np.ndarray, begin: np.ndarray, end: np.ndarray, alike: np.ndarray, chunk: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exits and tokens of (chunk, entry); equal ones run once."""
        _, one, back = np.unique(self._pair_key(alike[chunk], entry), return_index=True, return_inverse=True)
        exits, tokens = self.run(cls, begin[chunk[one]], end[chunk[one]], entry[one])
        return exits[back.reshape(-1)], tokens[back.reshape(-1)]

    def _compose(self, segment: np.ndarray, place: np.ndarray, chunk: np.ndarray, entry: np.ndarray, exits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Each segment's tokens: in every round a map takes up the one after it, so half as many are left (the up-sweep of a
        prefix scan; of its prefixes only the whole is asked for)."""
        owner, at, left = segment[chunk], place[chunk], int(place.max()) + 1
        while left > 1:
            half = (left + 1) // 2
            key = (owner * half + at // 2) * 2 + at % 2
            order = np.argsort(self._pair_key(key, entry), kind="stable")
            owner, at, entry, exits, tokens, key = (v[order] for v in (owner, at, entry, exits, tokens, key))
            keys = self._pair_key(key, entry)
            first = np.flatnonzero(at % 2 == 0)
            want = self._pair_key(key[first] + 1, exits[first])
            found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            has = keys[found] == want  # none where a segment ends with an odd number of maps
            exits[first[has]], tokens[first[has]] = exits[found[has]], tokens[first[has]] + tokens[found[has]]
            owner, at, entry, exits, tokens = owner[first], at[first] // 2, entry[first], exits[first], tokens[first]
            left = half
        whole = np.zeros(int(segment.max()) + 1, np.int64)
        start = entry == 0
        whole[owner[start]] = tokens[start]
        return whole

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each row."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.fast:
            return n_bytes, np.array([len(x) for x in self.library.encode(column.to_pylist(), num_threads=1)], np.int64)
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        out = np.zeros(len(column), np.int64)
        for at, to, data, offsets in K.blocks(column):
            if len(data):
                out[at:to] = self._block(data, offsets)
        return n_bytes, out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        cls = self.number[points]
        known, blank = cls > 0, cls == self.space
        start = np.zeros(len(cls) + 1, bool)
        start[first] = True
        start = start[:-1]
        start[1:] |= (blank[1:] & ~blank[:-1]) | ~known[1:] | ~known[:-1]
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cls))
        tokens = np.zeros(len(s), np.int64)
        odd = ~known[s]
        p = points[s[odd]]
        tokens[odd] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        k = np.flatnonzero(~odd)
        h = K.coded(self.code[cls], s[k], e[k])
        if self.known.n > MOST_SEGMENTS:
            self.known, self.counts = K.HashIndex(16), np.zeros(0, np.int64)
        slot = self.known.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            got = self.count(cls, s[k[new[one]]], e[k[new[one]]])
            self.known.add(fresh)
            self.counts = np.concatenate([self.counts, got])
            slot[new] = self.known.find(h[new])
        tokens[k] = self.counts[slot]
        total = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(total[np.searchsorted(s, first)])


class OtherTokenizer:
    """.json files: the tokenizers library, or its vectorised equal where that is proven."""

    def __init__(self, path: str):
        from .bpe import tokenizer

        self.bpe = tokenizer(path)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n_bytes = pc.binary_length(pc.fill_null(column.cast(pa.large_string()), "")).to_numpy(zero_copy_only=False).astype(np.int64)
        return n_bytes, np.concatenate([np.zeros(0, np.int64), *(c for _, _, c in self.bpe.encode(column))])


_loaded: dict[str, BpeTransducer | OtherTokenizer] = {}


def counter(path: str) -> BpeTransducer | OtherTokenizer:
    if path not in _loaded:
        _loaded[path] = OtherTokenizer(path) if path.endswith(".json") else BpeTransducer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            n_bytes, n = tool.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(count), SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
