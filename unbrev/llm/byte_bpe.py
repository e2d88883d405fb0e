"""Byte-level BPE by recursive DuckDB queries inside each partition.

Token-position rows ``(word, pos, tok)`` join the merge table; each step contracts
every word's leftmost pair of the lowest rank, until no word has a pair left.  An
ordered aggregation of the tokens' bytes decodes.  Spark deals out the documents; a
task works out each distinct word once and puts texts together from words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from unbrev.llm.common import parts_by_rows

#: Distinct words a task remembers before it starts anew.
REMEMBERED = 1_000_000
#: Tokens decoded in one query.
DECODED = 400_000
#: Words of more bytes than this are contracted apart from the others, so that their
#: many steps do not pass over the rows of short words.
LONG = 64

# Every step yields a row for each word that still has a pair: its tokens are spread
# out to positions, joined with the merge table, and put together again.
_ENCODE = """
WITH RECURSIVE state(word, toks) AS (
  SELECT word, list(tok ORDER BY pos) FROM start GROUP BY word
  UNION ALL
  SELECT state.word, list_concat(
    list_concat(list_slice(toks, 1, spot - 1), [merged]), list_slice(toks, spot + 2, len(toks)))
  FROM state JOIN (
    SELECT word, (min(pair) & 4294967295)::INT AS spot, (min(pair) >> 32)::INT AS merged
    FROM (
      SELECT word, (merges.merged::BIGINT << 32) | pos AS pair
      FROM (
        SELECT word, unnest(list_slice(toks, 1, len(toks) - 1)) AS first,
          unnest(list_slice(toks, 2, len(toks))) AS second, unnest(range(1, len(toks))) AS pos
        FROM state
      ) AS pairs JOIN merges USING (first, second)
    )
    GROUP BY word
  ) AS best ON best.word = state.word
)
SELECT word, arg_min(toks, len(toks)) AS ids FROM state GROUP BY word ORDER BY word
"""
# The same for long words, whose steps would pile up: one row per position, and only
# the rows that change are written.
_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM start
  UNION
  SELECT word, unnest([pos, next_pos]), unnest([merged, -1])
  FROM (
    SELECT word, arg_min(pos, (rank, pos)) AS pos, arg_min(next_pos, (rank, pos)) AS next_pos,
      min(rank) AS merged
    FROM (
      SELECT s.word, s.pos, s.next_pos, merges.merged AS rank
      FROM (
        SELECT word, pos, tok,
          lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next_tok,
          lead(pos) OVER (PARTITION BY word ORDER BY pos) AS next_pos
        FROM recurring.state
        WHERE tok >= 0 AND word IN (SELECT word FROM state)
      ) AS s
      JOIN merges ON merges.first = s.tok AND merges.second = s.next_tok
    )
    GROUP BY word
  )
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY word ORDER BY word
"""
_DECODE = """
SELECT text, string_agg(bytes, '' ORDER BY pos) AS bytes
FROM tokens JOIN vocabulary USING (tok) GROUP BY text ORDER BY text
"""


class Tokenizer:
    """One task's DuckDB database: vocabulary, merge table, words seen so far."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(pattern).findall
        self.words: dict[str, str] = {}
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '300MB'")
        first, second, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    first.append(a)
                    second.append(b)
                    merged.append(rank)
        self._load("merges", first=first, second=second, merged=merged)
        self._load(
            "vocabulary", tok=list(self.ranks.values()), bytes=[t.hex() for t in self.ranks]
        )
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _load(self, name: str, **columns: list) -> None:
        arrow = pa.table({k: pa.array(v, pa.string() if k == "bytes" else pa.int32()) for k, v in columns.items()})
        self.db.register("_arrow", arrow)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _arrow")
        self.db.unregister("_arrow")

    def _contract(self, words: list[bytes], query: str = _ENCODE) -> list[list[int]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(words)), sizes)
        start = pa.table(
            {
                "word": pa.array(word, pa.int32()),
                "pos": pa.array(np.arange(first[-1]) - first[word], pa.int32()),
                "tok": pa.array(self.bytes[np.frombuffer(b"".join(words), np.uint8)], pa.int32()),
            }
        )
        self.db.register("start", start)
        found = self.db.execute(query).fetchall()
        self.db.unregister("start")
        return [ids for _, ids in found]

    def learn(self, words: list[str]) -> None:
        """Work out the ids of words not seen before."""
        long: list[str] = []
        short: list[str] = []
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = str(whole)
            else:
                (short if len(raw) <= LONG else long).append(word)
        for group, size, query in ((long, 1_000, _ENCODE_LONG), (short, 50_000, _ENCODE)):
            for at in range(0, len(group), size):
                part = group[at : at + size]
                for word, ids in zip(part, self._contract([w.encode() for w in part], query)):
                    self.words[word] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal, joined by commas.

        New words of all texts are worked out together.
        """
        split = [self.split(text) for text in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known = self.words
        self.learn(list({w: None for words in split for w in words if w not in known}))
        return [",".join([known[w] for w in words]) for words in split]

    def decode(self, texts: list[np.ndarray]) -> Iterator[bytes]:
        """The bytes of each sequence of ids."""
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= DECODED):
                held += len(texts[stop])
                stop += 1
            part = texts[at:stop]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            first = np.concatenate([[0], np.cumsum(sizes)])
            text = np.repeat(np.arange(len(part)), sizes)
            tokens = pa.table(
                {
                    "text": pa.array(text, pa.int32()),
                    "pos": pa.array(np.arange(first[-1]) - first[text], pa.int32()),
                    "tok": pa.array(np.concatenate(part), pa.int32()),
                }
            )
            self.db.register("tokens", tokens)
            found = dict(self.db.execute(_DECODE).fetchall())
            self.db.unregister("tokens")
            for number in range(len(part)):
                yield bytes.fromhex(found.get(number, ""))
            at = stop


_TOKENIZER: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary, kept from task to task."""
    key = (ranks_path, pattern)
    if key not in _TOKENIZER:
        _TOKENIZER[key] = Tokenizer(ranks_path, pattern)
    return _TOKENIZER[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text and with ``ids array<int>``, ids of the whole text.

    A null text is encoded as an empty one.  Other columns are handed through, but
    one named ``ids`` is replaced.
    """
    docs = docs.drop("ids")
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_path, pattern)
        for batch in parts_by_rows(batches, 512):
            ids = [numbers(x) for x in own.encode([t or "" for t in batch.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(ids, pa.list_(pa.int32()))],
                [*(f.name for f in others), "ids"],
            )

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``rows`` with ``ids`` replaced by ``bytes binary`` (null ids: empty)."""
    rows = rows.drop("bytes")
    others = [f for f in rows.schema.fields if f.name != "ids"]
    schema = T.StructType([*others, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_path, pattern)
        for batch in parts_by_rows(batches, 512):
            ids = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(list(own.decode(ids)), pa.binary())],
                [*(f.name for f in others), "bytes"],
            )

    return rows.mapInArrow(run, schema)


def numbers(ids: str) -> np.ndarray:
    """Ids as :meth:`Tokenizer.encode` spells them, as numbers."""
    return np.array(ids.split(",") if ids else [], dtype=np.int32)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens, ids_sha256, decoded_sha256``.

    Encodes every whole text, decodes the ids again, and gives digests of both, so
    that neither has to leave the task.  Null texts count as empty; columns of the
    added names are replaced; repeated rows are encoded one by one; no rows, no
    result.
    """
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    docs = docs.drop(*added)
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in parts_by_rows(batches, 512):
            coded = own.encode([t or "" for t in batch.column(text).to_pylist()])
            ids = [numbers(x) for x in coded]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in others),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha(x.encode()) for x in coded], pa.string()),
                    pa.array([sha(x) for x in own.decode(ids)], pa.string()),
                ],
                [*(f.name for f in others), *added],
            )

    return docs.mapInArrow(run, schema)
