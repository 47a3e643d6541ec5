"""Hierarchical multi-length packing.

Documents are cut into full long windows; what remains of each is routed to the smallest context tier that holds it.
Each tier is packed into windows of its own size, gaps of long windows are filled from the shorter tiers, and the last
gap of a window takes the head of a short remainder (documents may be cut anywhere), so a window is always full. What
is left when a partition ends is split into windows of powers of two, so no window needs padding. Windows of a tier are
numbered into step groups that hold the same number of tokens whatever the tier.

A partition packs its own documents: nothing is shuffled, memory is bounded by `BUFFER_TOKENS` plus one document, and a
task that is run again yields the same windows, as they depend on the partition's rows alone.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 8192
#: Tokens of remainders that wait in a task before they are packed.
BUFFER_TOKENS = 1 << 20
END = 0
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, sequence_tokens long, step_group long"
)


class Encoder:
    """Token ids of `tokenizers`' file `json_path` without added special tokens.

    `rank_path`, if given, is the same vocabulary as ranks: a faster library then computes the same ids. A text that
    it can't take goes to `tokenizers`.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None, specials: dict[str, int]):
        self.json_path, self.fast, self.exact = json_path, None, None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
            except BaseException as e:  # a panic of the library isn't an Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json_path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Packs one partition's documents; `rows` gathers the pieces."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS):
        self.tiers, self.step_tokens, self.buffer_tokens = tuple(sorted(tiers)), step_tokens, buffer_tokens
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.base, self.next, self.held, self.serial = base, 0, 0, 0
        #: By tier: sorted (length, serial); the pieces themselves by serial.
        self.waiting: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}
        self.pieces: dict[int, tuple] = {}
        self.filled: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        long, n = self.tiers[-1], len(ids)
        for start in range(0, n - long + 1, long):
            self._emit(long, [(doc_id, start, ids[start : start + long], n)])
        if rest := n % long:
            self._route((doc_id, n - rest, ids[n - rest :].copy(), n))
            if self.held >= self.buffer_tokens:
                self.flush()

    def _route(self, piece: tuple) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if t >= n)
        self.serial += 1
        self.pieces[self.serial] = piece
        self.held += n
        insort(self.waiting[tier], (n, self.serial))

    def _take(self, tier: int, at: int) -> tuple:
        n, serial = self.waiting[tier].pop(at)
        self.held -= n
        return self.pieces.pop(serial)

    def _fitting(self, tier: int, gap: int) -> tuple | None:
        """The longest waiting piece of `tier` or a shorter one that fits into `gap`."""
        for t in reversed([t for t in self.tiers if t <= tier]):
            at = bisect_right(self.waiting[t], (gap, 1 << 62)) - 1
            if at >= 0:
                return self._take(t, at)
        return None

    def _shortest(self, tier: int) -> tuple | None:
        for t in self.tiers:
            if t <= tier and self.waiting[t]:
                return self._take(t, 0)
        return None

    def flush(self) -> None:
        """Pack full windows, long tiers first, while the waiting pieces of a tier and the shorter ones fill one."""
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                if sum(self._tokens(t) for t in self.tiers if t <= tier) < tier:
                    break
                window, gap = [self._take(tier, len(self.waiting[tier]) - 1)], tier
                gap -= len(window[0][2])
                while gap:
                    piece = self._fitting(tier, gap)
                    if piece is None:
                        doc_id, start, ids, n = self._shortest(tier)
                        piece = (doc_id, start, ids[:gap], n)
                        self._route((doc_id, start + gap, ids[gap:], n))
                    window.append(piece)
                    gap -= len(piece[2])
                self._emit(tier, window)

    def _tokens(self, tier: int) -> int:
        w = self.waiting[tier]
        return len(w) if len(w) > self.tiers[-1] else sum(n for n, _ in w)  # a token each at least

    def finish(self) -> None:
        self.flush()
        left = [self._take(t, 0) for t in self.tiers for _ in range(len(self.waiting[t]))]
        size = 1 << max(0, sum(len(p[2]) for p in left).bit_length() - 1)
        size = min(size, self.tiers[-1])
        while left:
            while sum(len(p[2]) for p in left) < size:
                size >>= 1
            window, gap = [], size
            while gap:
                doc_id, start, ids, n = left.pop()
                window.append((doc_id, start, ids[:gap], n))
                if len(ids) > gap:
                    left.append((doc_id, start + gap, ids[gap:], n))
                gap -= len(window[-1][2])
            self._emit(size, window)

    def _emit(self, tier: int, window: list[tuple]) -> None:
        serial = self.filled[tier] = self.filled.get(tier, -1) + 1
        step = self.base | tier << 24 | serial // max(1, self.step_tokens // tier)
        total, offset = sum(len(p[2]) for p in window), 0
        for doc_id, start, ids, n in window:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.base | self.next, offset, tier, total, step))
            offset += len(ids)
        self.next += 1


def pack(df: DataFrame, tokenizer: dict, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of each document (its token ids, then `END`).

    `tokenizer`: arguments of `Encoder`. Null text counts as empty (one piece of the end id), null ids stay null, repeated
    rows are packed each, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(**tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, tiers, step_tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4"))
                if len(packer.rows) >= 20_000:
                    yield table(packer)
        packer.finish()
        yield table(packer)

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def table(packer: Packer) -> pa.RecordBatch:
        cols = list(zip(*packer.rows)) or [()] * len(names)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, cols)], names)

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, SCHEMA)


def public_tokenizer(json_name: str = "byte_bpe_50k.json", rank_name: str | None = "byte_bpe_50k.tiktoken") -> dict:
    """Arguments of `Encoder` for an installed public vocabulary."""
    import public_tokenizers as P

    return {"json_path": P.path(json_name), "rank_path": rank_name and P.path(rank_name), "pattern": P.PATTERN, "specials": {"<|endoftext|>": 50256}}
