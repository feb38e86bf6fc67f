"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

The merge list decides how far a token's right edge can feel what follows: a merge (a, b) may be
pre-empted by an earlier merge of b with its right neighbour, that one by a still earlier merge
of the neighbour, and so on with falling ranks.  :func:`lookahead` bounds that chain in bytes.

A text is read in chunks and parted into pre-tokens.  Every pre-token goes through :class:`_Run`,
which keeps, for each byte of a sliding window, the last token of the prefix that ends there, and
emits the part on which all continuations agree.  A :class:`_State` names the tokens that end at a byte.  A run without a break is fed as it comes, so
memory does not grow with the text; what a short pre-token gave is kept in a bounded table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm._spark import lean

#: Code points read at once, the longest pre-token that is fed at once, entries of the table.
CHUNK, LONGEST, MEMO = 1 << 16, 256, 1 << 18
_WS = r"\t-\r \x85\xa0  -     　"
_KINDS = (("L", r"\p{L}"), ("N", r"\p{N}"), ("O", rf"[^{_WS}\p{{L}}\p{{N}}]"), ("S", rf"[{_WS}]"))
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Code points after a match that may still change it ("'r" + "e", a space before a word).
_HOLD = 3


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"] and not t["normalized"]}
        vocabulary = {k: v for k, v in file["model"]["vocab"].items() if k not in self.special}
        self.ids = {raw(k): v for k, v in vocabulary.items()}
        pairs = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in file["model"]["merges"]]
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): i for i, (a, b) in enumerate(pairs)}
        self.made = [self.ids[raw(a + b)] for a, b in pairs]
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.single = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.halves = {made: (a, b, i) for ((a, b), i), made in zip(self.rank.items(), self.made, strict=True)}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.ahead = lookahead(self)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's edge (0 left, 1 right) while it is made, each with the rank that ends it."""
        if (token, side) not in self.spines:
            out, until = [(token, len(self.made))], token
            while until in self.halves:
                rank, until = self.halves[until][2], self.halves[until][side]
                out.append((until, rank))
            self.spines[token, side] = out
        return self.spines[token, side]

    def stand(self, a: int, b: int) -> bool:
        """Whether two tokens stay two side by side: no merge of what is at their border comes first.

        Of merges of equal rank the leftmost goes first.
        """
        for x, ends in self.spine(a, 1):
            for y, closes in self.spine(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < ends and r <= closes:
                    return False
        return True


@lru_cache(2)
def load(path: str) -> Merges:
    return Merges(path)


def lookahead(merges: Merges) -> int:
    """Bytes after a token that can still change it: the longest chain of pre-empting merges."""
    right: dict[int, list[int]] = {}  # the tokens along the right edge of a token's derivation
    reach: dict[int, int] = {}
    for ((a, b), i) in merges.rank.items():  # by rising rank
        edge = lambda t: max((reach.get(x, 0) for x in [t, *right.get(t, ())]), default=0)
        felt = len(merges.bytes_of[b]) + edge(b)
        reach[a] = max(reach.get(a, 0), felt)
        right[merges.made[i]] = [b, *right.get(b, ())]
    return max(reach.values(), default=0)


class _State(dict):
    """A state of the read: the longest suffix of what was read that begins a token, and the tokens it ends with, longest first.

    The token of its last byte alone (-1: none) comes apart: where no longer one fits, nothing else
    is left.  Items are the states after one more byte, made when they are first met.
    """

    __slots__ = ("tables", "text", "ends", "single")

    def __init__(self, tables: _Tables, text: bytes):
        self.tables, self.text = tables, text
        found = ((tables.m.ids.get(text[i:]), len(text) - i) for i in range(len(text) - 1))
        self.ends = tuple((t, size) for t, size in found if t is not None)
        self.single = tables.m.single[text[-1]] if text else -1

    def __missing__(self, byte: int) -> _State:
        text = self.text + bytes([byte])
        while text not in self.tables.prefixes:
            text = text[1:]
        states = self.tables.states
        if text not in states:
            states[text] = _State(self.tables, text)
        out = self[byte] = states[text]
        return out


class _Fits(dict):
    """Whether two tokens stand side by side, by ``first << 32 | second``."""

    def __init__(self, merges: Merges):
        self.m = merges

    def __missing__(self, key: int) -> bool:
        if len(self) >= MEMO:
            self.clear()
        out = self[key] = self.m.stand(key >> 32, key & 0xFFFFFFFF)
        return out


class _Tables:
    """What all runs of an encoder share: the states of the read (as many as tokens have prefixes) and the pairs of tokens met."""

    def __init__(self, merges: Merges):
        self.m, self.ahead = merges, merges.ahead
        self.prefixes = {b""}.union(t[:i] for t in merges.ids for i in range(1, len(t) + 1))
        self.states: dict[bytes, _State] = {}
        self.root = self.states[b""] = _State(self, b"")
        self.fits = _Fits(merges)
        self.size = {t: len(b) for t, b in merges.bytes_of.items()}


class _Run:
    """The transducer within one long pre-token: feed bytes, get ids as soon as they are stable."""

    def __init__(self, tables: _Tables):
        self.tables, self.m, self.ahead = tables, tables.m, tables.ahead
        self.data = bytearray()
        self.last: list[int] = []  # last token of each prefix
        self.before = -1  # the token emitted last
        self.state = tables.root

    def whole(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is there in full: the last token of each prefix in turn, then back from the end."""
        state, fits, size_of, last = self.tables.root, self.tables.fits, self.tables.size, []
        for end, byte in enumerate(data):
            state = state[byte]
            for t, size in state.ends:
                if size > end or fits[last[end - size] << 32 | t]:
                    break
            else:
                t = state.single
                if t < 0:
                    raise ValueError("a byte sequence has no tokens")
            last.append(t)
        out, n = [], len(data)
        while n:
            out.append(last[n - 1])
            n -= size_of[out[-1]]
        return out[::-1]

    def _path(self, end: int) -> list[tuple[int, int]]:
        """(end, token) back from the prefix of that length."""
        out = []
        while end > 0:
            t = self.last[end - 1]
            out.append((end, t))
            end -= len(self.m.bytes_of[t])
        return out

    def feed(self, data: bytes, final: bool = False) -> list[int]:
        fits, longest, end = self.tables.fits, self.m.longest, len(self.data)
        self.data += data
        for byte in data:
            end += 1
            self.state = self.state[byte]
            for t, size in self.state.ends:
                if size > end:  # begins in what has been emitted
                    continue
                before = self.last[end - size - 1] if end > size else self.before
                if before < 0 or fits[before << 32 | t]:
                    break
            else:
                t = self.state.single
                if t < 0:
                    raise ValueError("a byte sequence has no tokens")
            self.last.append(t)
        n = len(self.data)
        if final:
            out = [t for _, t in reversed(self._path(n))]
            self.data, self.last, self.before, self.state = bytearray(), [], -1, self.tables.root
            return out
        if n < self.ahead + longest:
            return []
        agreed = dict(self._path(n))
        for end in range(n - longest + 1, n):  # a later token begins at one of these ends
            agreed = {e: t for e, t in self._path(end) if agreed.get(e) == t}
        if not agreed:
            return []
        cut = max(agreed)
        out = [t for _, t in reversed(self._path(cut))]
        self.before = out[-1]
        del self.data[:cut]
        del self.last[:cut]
        return out


class Encoder:
    """Ids of texts, as byte strings of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.m = load(path)
        self.tables = _Tables(self.m)
        self.run = _Run(self.tables)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.m.special, key=len, reverse=True))) if self.m.special else None
        self.hold = max((len(x) for x in self.m.special), default=1) - 1
        outer = self

        class Memo(dict):
            older: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                if len(self) >= MEMO:  # words met since the last turn stay, others go
                    self.older = dict(self)
                    self.clear()
                out = self.older.get(word)
                if out is None:
                    ids = outer.run.whole(word.encode())
                    out = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) <= 64:
                    self[word] = out
                return out

        self.memo = Memo()

    def encode(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids of one text that comes in chunks of any size."""
        tail = ""
        splitter = _Splitter(self)
        for chunk in chunks:
            text = tail + chunk
            at = 0
            if self.special is not None:
                for hit in self.special.finditer(text):
                    yield from splitter.feed(text[at : hit.start()], True)
                    yield np.asarray([self.m.special[hit.group()]], "<u4").tobytes()
                    at = hit.end()
            stop = max(at, len(text) - self.hold)
            yield from splitter.feed(text[at:stop], False)
            tail = text[stop:]
        yield from splitter.feed(tail, True)


class _Splitter:
    """Pre-tokens of a stream; a run beyond :data:`LONGEST` is passed on while it is open."""

    def __init__(self, encoder: Encoder):
        self.e, self.rest, self.run, self.kind = encoder, "", None, None

    def feed(self, text: str, final: bool) -> Iterator[bytes]:
        text = self.rest + text
        self.rest = ""
        at = 0
        if self.run is not None:
            at = yield from self._continue(text, final)
            if self.run is not None:
                return
        words = _SPLIT.findall(text, at)
        if not final:
            keep = len(text) - _HOLD
            end = len(text)
            while words and end > keep:
                end -= len(words[-1])
                last = words.pop()
            if not words and end > keep:
                end = at
            self.rest = text[end:]
            if len(self.rest) > LONGEST and len(last) > LONGEST and len(self.rest) - len(last) <= _HOLD:
                # one pre-token reaches the end of what has come: hand over all but the last code points
                yield from self._emit(words)
                words = []
                first = last[1] if last[0] == " " and last[1:2].strip() else last[0]
                self.kind = next(p for _, p in _KINDS if regex.match(p, first))
                self.run = _Run(self.e.tables)
                body, self.rest = self.rest[:-_HOLD], self.rest[-_HOLD:]
                yield self._ids(self.run.feed(body.encode()))
        yield from self._emit(words)

    def _continue(self, text: str, final: bool):
        stop = regex.match(f"(?:{self.kind})*", text).end()
        space = self.kind == _KINDS[3][1]
        if stop == len(text) and not final:
            body, self.rest = text[: max(0, stop - _HOLD)], text[max(0, stop - _HOLD) :]
            yield self._ids(self.run.feed(body.encode()))
            return 0
        if not final and stop > len(text) - _HOLD and not space:
            pass  # the run has ended: what follows cannot join it
        if space and stop < len(text):
            stop -= 1  # the last space belongs to the word after it
        yield self._ids(self.run.feed(text[:stop].encode(), True))
        self.run = None
        return stop

    def _emit(self, words: list[str]) -> Iterator[bytes]:
        if not words:
            return
        if max(map(len, words)) <= LONGEST:
            yield b"".join(map(self.e.memo.__getitem__, words))
            return
        for w in words:
            if len(w) <= LONGEST:
                yield self.e.memo[w]
            else:
                run = _Run(self.e.tables)
                data = w.encode()
                for i in range(0, len(data), 1024):
                    yield self._ids(run.feed(data[i : i + 1024]))
                yield self._ids(run.feed(b"", True))

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()


class Decoder:
    """Text of ids that come in pieces; bytes wait until their code point is whole, broken ones become U+FFFD."""

    def __init__(self, path: str):
        m = load(path)
        self.table = [m.bytes_of.get(i, b"") for i in range(max(m.bytes_of) + 1)]

    def decode(self, pieces: Iterable[bytes]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.table.__getitem__
        for piece in pieces:
            yield state.decode(b"".join(map(of, np.frombuffer(piece, "<u4").tolist())))
        yield state.decode(b"", True)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    for i in range(0, len(text), size):
        yield text[i : i + size]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``ids`` holds the tokens as little-endian unsigned 32-bit integers.  Null text counts as
    empty and has no tokens; repeated rows stay repeated; an empty table gives none.  Map-only.
    """
    kept = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, decoder = Encoder(tokenizer), Decoder(tokenizer)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                n, digest, back, every = 0, hashlib.sha256(), hashlib.sha256(), []

                def passed():
                    nonlocal n
                    for piece in to_ids.encode(chunks(text)):  # noqa: B023
                        n += len(piece) // 4
                        digest.update(piece)  # noqa: B023
                        if ids:
                            every.append(piece)  # noqa: B023
                        yield piece

                for said in decoder.decode(passed()):
                    back.update(said.encode())
                rows.append((n, digest.hexdigest(), back.hexdigest(), b"".join(every)))
            columns = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([r[3] for r in rows], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), kept)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
