"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a model holds a whitespace marker after another character, no merge can
cross from a word into the next marker, so a text falls into chunks (a run of markers and
the characters up to the next marker) that are segmented independently. Each task keeps a
table from distinct chunks to their ids; a chunk is segmented once, when first seen, and a
text's ids are the table's entries joined by position. The table is bounded: when full it
is emptied, which costs time only.

Nulls count as the empty text, which has only the begin and end ids. Repeated rows give
repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import ship, slices, texts_of

ship(__name__)

MARK = "▁"


class ChunkTable:
    """Distinct marked words of a model with their ids (little-endian uint32) and decoded text.

    ``max_entries`` bounds the table, ``max_bytes`` the text it holds; longer chunks than
    ``max_chunk`` are segmented each time and not kept.
    """

    def __init__(self, model: bytes, max_entries: int = 300_000, max_chunk: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = self._spec(model)
        crossing = any(MARK in self.sp.id_to_piece(i).lstrip(MARK) for i in range(self.sp.get_piece_size()) if not self.sp.is_control(i))
        if crossing or not spec:
            raise ValueError("pieces of this model cross whitespace markers or it rewrites its input; chunks can't be told apart")
        self.max_entries, self.max_chunk = max_entries, max_chunk
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.begin, self.end = (i.to_bytes(4, "little") for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.lead = self._ids([MARK + "a"])[0]

    @staticmethod
    def _spec(model: bytes) -> bool:
        """Whether the model keeps its input as it is but for a dummy prefix and the marker."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        return n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not n.precompiled_charsmap and not m.trainer_spec.treat_whitespace_as_suffix

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the library adds a marker of its own, which the chunk gives up first."""
        found = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [[self.sp.piece_to_id(MARK)] if c == MARK else ids for c, ids in zip(chunks, found, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self._ids(chunks), strict=True):
            self.ids[chunk] = b"".join(i.to_bytes(4, "little") for i in ids)
            decoded = self.sp.decode([*self.lead, *ids])
            self.text[chunk] = decoded[1:]

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a whole text as bytes, with begin and end, and the decoded text."""
        if not text:
            return self.begin + self.end, ""
        parts = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        if "" in parts:  # runs of markers belong to the word that follows; a run at the end stands alone
            chunks, run = [], ""
            for p in parts:
                run += MARK
                if p:
                    chunks.append(run + p)
                    run = ""
            if run:
                chunks.append(run)
        else:
            chunks = [MARK + p for p in parts]
        try:
            ids = b"".join(map(self.ids.__getitem__, chunks))
            out = "".join(map(self.text.__getitem__, chunks))
        except KeyError:
            if len(self.ids) > self.max_entries:
                self.ids.clear()
                self.text.clear()
            self.learn([c for c in dict.fromkeys(chunks) if c not in self.ids])
            ids = b"".join(map(self.ids.__getitem__, chunks))
            out = "".join(map(self.text.__getitem__, chunks))
            for c in chunks:
                if len(c) > self.max_chunk:
                    self.ids.pop(c, None)
                    self.text.pop(c, None)
        return self.begin + ids + self.end, out[1:] if out[:1] == " " else out


def read_model(path: str) -> bytes:
    """The model's bytes, read once by the driver and sent with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_output``, ids and decoded.

    One pass without a shuffle; ids have begin and end. ``model_path`` is read on the driver.
    """
    model = read_model(model_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output

    def run(batches):
        import numpy as np

        table = ChunkTable(model)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for lo, hi in slices(texts):
                done = [table.encode(t.decode("utf-8", "replace")) for t in texts[lo:hi]]
                cols = {
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "n_tokens": pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(out.encode()).hexdigest() for _, out in done], pa.string()),
                }
                if with_output:
                    cols["ids"] = pa.array([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in done], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array([out for _, out in done], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
