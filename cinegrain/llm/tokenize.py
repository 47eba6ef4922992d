"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the tokenizer's published pattern. A piece is encoded without replaying its merges: its
bytes, as Latin-1 characters, go through an Aho-Corasick automaton of the vocabulary that gives every match; from the
longest match at each place a walk goes on while neighbouring tokens are compatible and steps back where they are not.
Compatibility of two tokens (encoding their bytes gives just these two) is worked out once and kept, and a place found
to be a dead end is never entered again, so the walk is linear in the piece. The result is that of the exact merges.
"""

from __future__ import annotations

import base64
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern of the byte-level vocabularies.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


MOST_KEPT = 200_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class ByteBpe:
    """Exact byte-level BPE of one vocabulary; ``encode`` gives the ids of a text."""

    def __init__(self, ranks: dict[bytes, int], most_kept: int = MOST_KEPT):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.most_kept = most_kept
        self.units = _Memo(self._unit, most_kept)

    def merged(self, piece: bytes) -> list[int]:
        """The merges replayed one by one, smallest rank first; used for pairs of tokens and as the test's yardstick."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    at, best = i, rank
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= self.most_kept:
                self.compatible.clear()
            known = self.compatible[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - size + 1].append((size, rank))
        for options in starts:
            options.sort()  # the longest is taken from the end
        dead = bytearray(n + 1)
        path: list[tuple[int, int]] = []  # (place, id)
        at, options = 0, starts[0]
        while at < n:
            last = path[-1][1] if path else None
            while options:
                size, rank = options.pop()
                if not dead[at + size] and (last is None or self.fits(last, rank)):
                    path.append((at, rank))
                    at += size
                    # A place is entered anew after each step back, so it needs all its options again.
                    options = starts[at].copy() if at < n else []
                    break
            else:
                dead[at] = 1
                at, rank = path.pop()
                size = len(self.bytes_of[rank])
                options = [o for o in starts[at] if o[0] < size]
        return [rank for _, rank in path]

    def _unit(self, unit: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.piece(p.encode("utf-8", "surrogatepass")) for p in self.find(unit)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and the empty text.

        A single space always starts a piece unless it stands between white space, or white space and the end, so a text
        without such a space is encoded word by word, and words are remembered.
        """
        if not text:
            return []
        units = self.units
        if "  " in text or _INNER_SPACE.search(text):
            words = self.find(text)
        else:
            first, *rest = text.split(" ")
            words = [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]
        units.make_room()
        return list(chain.from_iterable(map(units.__getitem__, words)))


_INNER_SPACE = regex.compile(r"\p{White_Space} (?=\p{White_Space}|\Z)")


class _Memo(dict):
    """Remembers a function's results, at most so many."""

    def __init__(self, f, most: int):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(key) > 200:
            return self.f(key)
        value = self[key] = self.f(key)
        return value

    def make_room(self) -> None:
        if len(self) > self.most:
            self.clear()


_BUILT: dict[int, ByteBpe] = {}


def built(raw: bytes) -> ByteBpe:
    """The encoder of a vocabulary, made once in each Python worker."""
    key = hash(raw)
    if key not in _BUILT:
        _BUILT[key] = ByteBpe(read_ranks(raw))
    return _BUILT[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # of fixed size, under 1 MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, without special tokens.

    One narrow pass: two columns go to Python in Arrow batches, there is no shuffle. Defined cases: an empty list for
    a null or empty text; a null key stays null; repeated rows come out as often; other columns are left alone.
    """
    shared = _vocabulary(df, vocabulary)

    def run(batches):
        encode = built(shared.value).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema).toDF(key, "ids")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids of the text; 0 for a null or empty one."""
    shared = _vocabulary(df, vocabulary)

    def run(batches):
        encode = built(shared.value).encode
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) for t in batch.column(len(keep)).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(sizes)], names=[*[f"k{i}" for i in range(len(keep))], "n"])

    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keep)], T.StructField("n", T.LongType())])
    return df.select(*keep, text).mapInArrow(run, schema).toDF(*keep, "n_tokens")
