"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi.

The automaton of all pieces reads the text once; at every position it yields the pieces that
end there, found by following output links, and each relaxes the best score of that position.
Characters that no piece covers become UTF-8 byte pieces. A text is cut before every run of
spaces: where no piece of the vocabulary crosses such a place, the best path of the whole is
the best paths of the parts, and parts that recur are encoded once per task.

Spaces are written as U+2581 and a space is put in front, as the library does; a literal
U+2581 is always written in bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from rowdeck.llm.common import map_batches, narrow, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_PARTS = 1 << 18
BYTE_COST = 10.0  # under the worst piece, for a byte where no piece fits


def load_pieces(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0 is normal, 1 a byte, 2 a control or unknown piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [1 if model.is_byte(k) else 2 if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) else 0 for k in range(model.vocab_size())]
    return [(model.id_to_piece(k), model.get_score(k), kinds[k]) for k in range(model.vocab_size())]


class Pieces:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.automaton = ahocorasick.Automaton()
        self.bytes = [-1] * 256
        self.output: list[bytes] = []
        worst, crossing = 0.0, False
        for k, (piece, score, kind) in enumerate(pieces):
            self.output.append(b"")
            if kind == 1:
                value = int(piece[3:5], 16)
                self.bytes[value] = k
                self.output[k] = bytes([value])
            elif kind == 0 and piece:
                self.automaton.add_word(piece, (len(piece), score, k))
                self.output[k] = piece.replace(SPACE, " ").encode()
                worst = min(worst, score)
                crossing |= re.fullmatch(f"{SPACE}*[^{SPACE}]*", piece) is None
        if -1 in self.bytes:
            raise ValueError("the vocabulary has no byte pieces: some texts could not be encoded")
        self.automaton.make_automaton()
        self.byte_score = worst - BYTE_COST
        self.parts = None if crossing else re.compile(f"{SPACE}+[^{SPACE}]*")
        self.cache: dict[str, bytes] = {}  # the ids as bytes: an array each would take three times the memory

    def best(self, text: str) -> np.ndarray:
        """Ids of the best-scoring path over one stretch; of equal paths the one whose last piece is
        longest, then of the smallest id. ``\\0`` stands for a literal U+2581."""
        size = len(text)
        scores = [0.0] + [None] * size
        steps: list[tuple[int, int]] = [(0, -1)] * (size + 1)
        reached = 0

        def by_bytes(upto: int) -> None:
            """Give every end below ``upto`` that no piece reached its byte step."""
            nonlocal reached
            while reached < upto:
                reached += 1
                if scores[reached] is None:
                    char = text[reached - 1]
                    width = len((SPACE if char == "\0" else char).encode("utf-8", "surrogatepass"))
                    scores[reached], steps[reached] = scores[reached - 1] + width * self.byte_score, (1, -1)

        for last, (length, score, k) in self.automaton.iter(text):
            by_bytes(last)
            end = last + 1
            total = scores[end - length] + score
            old = scores[end]
            if old is None or total > old or (total == old and (-length, k) < (-steps[end][0], steps[end][1])):
                scores[end], steps[end] = total, (length, k)
        by_bytes(size)
        ids: list[int] = []
        at = size
        while at:
            length, k = steps[at]
            if k >= 0:
                ids.append(k)
            else:
                char = text[at - 1]
                ids.extend(self.bytes[b] for b in reversed((SPACE if char == "\0" else char).encode("utf-8", "surrogatepass")))
            at -= length
        return np.array(ids[::-1], np.int32)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if "\0" in text:  # free the stand-in: NUL itself is always written in bytes
            runs = re.split("(\0+)", text)
            return self._marked(runs)
        return self._plain(SPACE + text.replace(SPACE, "\0").replace(" ", SPACE))

    def _plain(self, marked: str) -> np.ndarray:
        parts = [marked] if self.parts is None else self.parts.findall(marked)
        cache, found = self.cache, []
        for part in parts:
            ids = cache.get(part)
            if ids is None:
                ids = self.best(part).tobytes()
                if len(part) <= 64:
                    if len(cache) >= CACHE_PARTS:
                        cache.clear()
                    cache[part] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)

    def _marked(self, runs: list[str]) -> np.ndarray:
        found = []
        for k, run in enumerate(runs):
            if k % 2:
                found.append(np.full(len(run), self.bytes[0], np.int32))
            elif k == 0:
                found.append(self._plain(SPACE + run.replace(SPACE, "\0").replace(" ", SPACE)))
            elif run:
                found.append(self._joined(run.replace(SPACE, "\0").replace(" ", SPACE)))
        return np.concatenate(found)

    def _joined(self, marked: str) -> np.ndarray:
        """A stretch after NUL characters, which starts without a space of its own."""
        if self.parts is None:
            return self.best(marked)
        head = re.match(f"[^{SPACE}]*", marked)[0]
        parts = [self.best(head)] if head else []
        return np.concatenate([*parts, self._plain(marked[len(head) :])] if len(marked) > len(head) else parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space put in front is taken off again."""
        whole = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


def encoded(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, n_pieces, n_chars, exact)``, one row per document row.

    ``exact`` says that decoding the ids gave the text back. A NULL text has NULL ids, no pieces
    and NULL in ``exact``; an empty text has none and is exact. Texts of any length are encoded
    whole, repeated rows alike, a NULL doc_id is carried through, other columns are ignored,
    an empty table gives no rows. The model file is read by the driver only and its pieces
    (a vocabulary, fixed in size) are broadcast.
    """
    docs = narrow(documents, doc_id=F.col("doc_id").cast("long"), text="text")
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    state: dict = {}

    def run(batch):
        if not state:
            state["pieces"] = Pieces(shared.value)
        pieces: Pieces = state["pieces"]
        for start in range(0, max(1, batch.num_rows), 256):
            part = batch.column("text").slice(start, 256).to_pylist()
            ids = [None if text is None else pieces.encode(text) for text in part]
            yield {
                "doc_id": batch.column("doc_id").slice(start, 256),
                "ids": _lists(ids),
                "n_pieces": [0 if x is None else len(x) for x in ids],
                "n_chars": [0 if text is None else len(text) for text in part],
                "exact": [None if text is None else pieces.decode(x) == text for text, x in zip(part, ids)],
            }

    return map_batches(docs, run, "doc_id long, ids array<int>, n_pieces long, n_chars long, exact boolean")


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    mask = pa.array([x is None for x in ids])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=mask)


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; NULL ids give a NULL text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_pieces(model))
    state: dict = {}

    def run(batch):
        if not state:
            state["pieces"] = Pieces(shared.value)
        texts = [None if x is None else state["pieces"].decode(np.array(x, np.int32)) for x in batch.column("ids").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": texts}

    return map_batches(narrow(tokens, doc_id="doc_id", ids="ids"), run, "doc_id long, text string")


def query(spark, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))
