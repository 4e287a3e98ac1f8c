"""Hierarchical packing of token sequences into windows of several context sizes."""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import map_texts
from paperloom.llm.tokens import load_tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Documents whose rests wait together for windows: bounds a task's memory.
WAITING = 2048


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, as the byte-level tokenizer file gives them, special
    strings included.  With ``ranks``, the same vocabulary's rank file, the faster library that reads it does the work: the
    merges and the splitting pattern are the same, and ``agrees`` says for some texts that both give the same ids.  A text
    that it cannot split goes to the file's own library."""

    def __init__(self, path: str, ranks: str | None):
        self.slow, self.fast = load_tokenizer(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)

    def by_file(self, text: str) -> bytes:
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None:
            return self.by_file(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # its pattern engine gives up on very long runs of white space
            return self.by_file(text)

    def agrees(self, texts: list[str]) -> bool:
        return all(self(t) == self.by_file(t) for t in texts)


@cache
def load_encoder(path: str, ranks: str | None) -> Encoder:
    """One for each Python worker; without the rank file if the two libraries ever disagree on a few awkward texts."""
    found = Encoder(path, ranks)
    return found if found.agrees(AWKWARD) else Encoder(path, None)


AWKWARD = ["", " ", "a  b\n\n c\t d ", "it's we'll I'D 12345 x², ½", "Straße çà ÉTÉ e\u0301", "<|endoftext|> <|endoftext|>x", "\u3000深度 学习\u200b🙂🏽", "\x00\x1c\x85\xa0z"]


class Packer:
    """Packs one task's documents.  Windows have ``tiers`` sizes (powers of two, ascending); a piece is
    (doc_id, start, length, crc, doc_tokens) and is written into exactly one place of one window.  Windows that are ready
    together are numbered in the order in which the document of their first, longest piece came."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_tokens: int):
        self.tiers, self.next_id, self.step_tokens = tiers, first_id, step_tokens
        self.first_id, self.dealt = first_id, dict.fromkeys(tiers, 0)
        self.rests: list[tuple[int, int, object, int, bytes]] = []
        self.seen = self.carried = 0
        self.windows: list[tuple[int, list[tuple], int]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        """Full windows of the largest tier are ready at once; the rest waits.  All get their numbers when the rests are
        dealt, which is after WAITING rests or full windows."""
        total, top = len(ids) // 4, self.tiers[-1]
        self.seen += 1
        for start in range(0, total - total % top, top):
            self._emit(self.seen, [(doc_id, start, total, ids[4 * start : 4 * (start + top)])], top)
        if total % top:
            start = total - total % top
            self.rests.append((total % top, self.seen, doc_id, start, ids[4 * start :], total))
        if len(self.rests) >= WAITING or len(self.windows) >= WAITING:
            self._fill(last=False)

    def finish(self) -> None:
        self._fill(last=True)

    def _fill(self, last: bool) -> None:
        """Route the waiting rests to their tiers, longest first: each opens a window of its tier, whose gap takes the
        longest shorter rests that fit; what is left of the gap takes the head of a rest that is cut there.  Only windows
        that are full leave; rests that do not fill one, which are less than one together, open the first window of the next
        time, so that none waits on and on.  A last window that is not full is split into powers of two."""
        carried, waiting = self.rests[: self.carried], sorted(self.rests[self.carried :], key=lambda x: x[:2])
        while carried or waiting:
            size = sum(x[0] for x in carried) or waiting[-1][0]
            tier = next(t for t in self.tiers if t >= size)
            if not last and sum(x[0] for x in carried + waiting[-tier:]) < tier:
                break
            window, carried, gap = carried or [waiting.pop()], [], tier - size
            while gap and waiting:
                k = bisect_right(waiting, gap, key=lambda x: x[0])
                if k:
                    window.append(waiting.pop(k - 1))
                    gap -= window[-1][0]
                else:
                    length, order, doc_id, start, ids, total = waiting.pop(0)
                    window.append((gap, order, doc_id, start, ids[: 4 * gap], total))
                    insort(waiting, (length - gap, order, doc_id, start + gap, ids[4 * gap :], total), key=lambda x: x[:2])
                    gap = 0
            self._emit_window(window[0][1], [(d, s, n, i) for _, _, d, s, i, n in window], tier, tier - gap)
        self.rests = sorted(carried + waiting, key=lambda x: x[1])
        self.carried = len(self.rests)
        self._number()

    def _emit_window(self, came: int, parts: list[tuple], tier: int, used: int) -> None:
        if used == tier:
            return self._emit(came, parts, tier)
        while used:  # the end of a task: the windows get smaller, none is padded
            size = 1 << (used.bit_length() - 1)
            head, left = [], size
            while left:
                doc_id, start, total, ids = parts.pop(0)
                take = min(left, len(ids) // 4)
                head.append((doc_id, start, total, ids[: 4 * take]))
                if take < len(ids) // 4:
                    parts.insert(0, (doc_id, start + take, total, ids[4 * take :]))
                left -= take
            self._emit(came, head, size)
            used -= size
        return None

    def _emit(self, came: int, parts: list[tuple], size: int) -> None:
        """Pieces of a window that is ready; of their ids, only the checksum stays."""
        pieces, offset = [], 0
        for doc_id, start, total, ids in parts:
            pieces.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, offset))
            offset += len(ids) // 4
        self.windows.append((came, pieces, size))

    def _number(self) -> None:
        """Windows of one size fill step groups of equal token counts, one after the other."""
        for _, pieces, size in sorted(self.windows, key=lambda x: x[0]):
            group = self.first_id + (self.dealt.setdefault(size, 0) // self.step_tokens) * 64 + size.bit_length()
            self.dealt[size] += size
            for doc_id, start, length, crc, total, offset in pieces:
                self.rows.append((doc_id, start, length, crc, total, self.next_id, offset, size, group))
            self.next_id += 1
        self.windows = []


def pack(docs: DataFrame, path: str, ranks: str | None = None, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its ids and ``end_id``; a null text is empty, so its document is that one id; texts of any length are read
    whole, and bytes that are not UTF-8 are replaced.  Ids, null or repeated, are only carried along: each row is a document
    of its own.  Documents that are equally long wait in the order in which they came.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.  Every task packs the rows it reads, so nothing is shuffled and
    a lost task is packed anew by itself; sequence ids are unique, as their upper bits are the task's.  Windows are full:
    sizes are those of ``tiers``, but for at most eleven smaller powers of two at a task's end.  A step group holds
    windows of one size, ``step_tokens`` together, but for the last of each size in a task.  Sequence ids, and the groups of
    one size, rise in the order of the rows that a task reads, but that about WAITING rows are packed together, and tasks
    in the order of their partitions: ordered partitions, as ``mixing.in_mixed_order`` gives, are packed in order.
    """
    columns = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int32() if c == "tier" else pa.int64() for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, TaskContext.get().partitionId() << 36, step_tokens)
        end, encode = end_id.to_bytes(4, "little"), load_encoder(path, ranks)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], columns)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), encode((text.as_py() or b"").decode("utf-8", "replace")) + end)
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_texts(narrow, run, PIECES)
