"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character (checked when the model is opened), so no
merge crosses the start of a run of markers. A marked text is cut before each such run, each distinct chunk is segmented
once by the library, and a text's ids are its chunks' ids joined by position. The table is kept from batch to batch and
started anew when it holds more than ``TABLE_CHARS`` characters, so memory is bounded and results are the same.

Defined results: a null text counts as empty; an empty text has no ids, and decodes to an empty text. Any white space other
than the blank is an ordinary character, as in the library. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from acreframe.llm._shared import mapped, slices

MARK = "▁"
_chunk = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHARS = 6_000_000


class ChunkTable:
    """Ids of the distinct chunks met so far, from a serialised model."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        names = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in names):
            raise ValueError("pieces of this vocabulary cross whitespace markers")
        self.known: dict[str, tuple[list[int], str]] = {}
        self.chars = 0
        self.lead = self.library.encode("a")

    def learn(self, chunks: list[str]) -> None:
        """Segment chunks that the table lacks."""
        if self.chars > TABLE_CHARS:
            self.known, self.chars = {}, 0
        wanted = list({c for c in chunks if c not in self.known})
        # The library puts a marker before each text, which is the chunk's first one.
        for chunk, ids in zip(wanted, self.library.encode([c[1:] for c in wanted], num_threads=1), strict=True):
            if len(chunk) == 1:  # a single marker at the end of a text; the library has no ids for an empty text
                ids = self.library.encode("a ")[len(self.lead) :]
            self.known[chunk] = (ids, ",".join(map(str, ids)))
            self.chars += len(chunk) + 4 * len(ids)

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, their decimals joined by commas) of each text."""
        cut = [_chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        out = []
        for chunks in cut:
            try:
                found = [self.known[c] for c in chunks]
            except KeyError:
                self.learn(chunks)
                found = [self.known[c] if c in self.known else self._late(c) for c in chunks]
            out.append(([i for ids, _ in found for i in ids], ",".join([x for _, x in found])))
        return out

    def _late(self, chunk: str) -> tuple[list[int], str]:
        """A chunk that left when the table started anew."""
        self.learn([chunk])
        return self.known[chunk]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _run(shipped, with_ids: bool):
    def run(batches):
        own = ChunkTable(shipped.value)
        for part in slices(batches, 256, 2_000_000):
            found = own.encode([t or "" for t in part.column(1).to_pylist()])
            back = own.library.decode([ids for ids, _ in found], num_threads=1) if found else []
            columns = [part.column(0), pa.array([len(ids) for ids, _ in found], pa.int64())]
            names = [part.schema.names[0], "n_tokens"]
            if with_ids:
                columns += [pa.array([ids for ids, _ in found], pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            else:
                columns += [pa.array([_sha256(x) for _, x in found], pa.string()), pa.array([_sha256(x) for x in back], pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _apply(rows: DataFrame, model_path: str, key: str, text: str, with_ids: bool, schema: str) -> DataFrame:
    with open(model_path, "rb") as f:  # on the driver; executors get the bytes
        shipped = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, text), _run(shipped, with_ids), f"{key} {kind}, n_tokens bigint, {schema}")


def tokenize(rows: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) of each row."""
    return _apply(rows, model_path, key, text, True, "ids array<int>, decoded string")


def token_digests(rows: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, without moving the ids themselves."""
    return _apply(rows, model_path, key, text, False, "ids_sha256 string, decoded_sha256 string")
