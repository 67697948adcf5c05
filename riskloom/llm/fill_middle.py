"""Fill-in-the-middle: a text's prefix, middle and suffix, cut between tokens that a bitvector numbers.

A token is a run of blanks with the word after it, or blanks at the end. One bit a byte marks where tokens begin. The
bits are packed, and a directory holds the popcounts before every block of them: the total popcount is the number of
tokens, and ``select`` of the two drawn ranks gives the bytes to cut at. A whole batch of texts shares one bitvector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, pieces, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42
#: Bytes of packed bits that one entry of the directory covers.
BLOCK = 64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: _NTH[b, r]: the place of the rth set bit of the byte b, low bits first.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [k for k in range(8) if _b >> k & 1]
    _NTH[_b, : len(_at)] = _at


class Bits:
    """A packed bitvector with rank and select."""

    def __init__(self, marks: np.ndarray) -> None:
        packed = np.packbits(marks, bitorder="little")
        self.packed = np.append(packed, np.zeros(-len(packed) % BLOCK, np.uint8)).reshape(-1, BLOCK)
        counts = np.bitwise_count(self.packed)
        self.inside = counts.cumsum(axis=1, dtype=np.uint16)  # up to and with each byte of its block
        self.before = np.append(0, self.inside[:, -1].cumsum(dtype=np.int64)) if len(self.packed) else np.zeros(1, np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits below each place."""
        block, byte = at // (8 * BLOCK), at // 8 % BLOCK
        out = self.before[block].copy()
        part = block < len(self.packed)
        b, y = block[part], byte[part]
        own = self.packed[b, y]
        out[part] += self.inside[b, y].astype(np.int64) - np.bitwise_count(own) + np.bitwise_count(own & ((1 << (at[part] % 8)) - 1).astype(np.uint8))
        return out

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of each set bit, numbered from 0."""
        block = np.searchsorted(self.before, rank, side="right") - 1
        left = rank - self.before[block]
        byte = (self.inside[block] <= left[:, None]).sum(axis=1)
        own = self.packed[block, byte]
        left = left - (self.inside[block, byte].astype(np.int64) - np.bitwise_count(own))
        return (block * BLOCK + byte) * 8 + _NTH[own, left]


def cuts(data: np.ndarray, ends: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text (bytes one after the other, with their ends), and the two bytes to cut at, counted within it.

    ``draws``: two numbers a text; their remainders by its tokens and one, in order, are the tokens before the cuts.
    """
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    blank = _BLANK[data]
    marks = np.zeros(len(data), bool)
    marks[1:] = blank[1:] & ~blank[:-1]
    full = ends > starts
    marks[starts[full]] = True
    bits = Bits(marks)
    first = bits.rank(starts)
    n = bits.rank(ends) - first
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    at = np.repeat((ends - starts)[:, None], 2, axis=1)
    row, col = np.nonzero(units < n[:, None])
    at[row, col] = bits.select(first[row] + units[row, col]) - starts[row]
    return n, at


PARTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("output", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def _arranged(text: bytes, form: str, cut: list[int]) -> tuple[bytes, int | None, int | None]:
    if form == "plain":
        return text, None, None
    a, b, c = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    whole = b"".join((p, a, s, c, m, b) if form == "psm" else (s, c, p, a, m, b))
    return whole, len(a.decode()), len(b.decode())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        draws = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1)
        n, at = cuts(np.frombuffer(b"".join(texts), np.uint8), ends, draws)
        forms = batch.column("form").to_pylist()
        made = [_arranged(*x) for x in zip(texts, forms, at.tolist(), strict=True)]
        yield arrow_rows(PARTS, doc_id=batch.column("doc_id"), n=n, form=forms, output=[x[0].decode() for x in made], prefix_chars=[x[1] for x in made], middle_chars=[x[2] for x in made])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), output, prefix_chars, middle_chars of every document.

    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those suffix first; draws hash the seed and the id, so
    reruns agree and repeated rows get the same. A null text is empty; empty texts and texts that hold a mark stay
    plain, as no output of theirs could be read back. A null id hashes as no digits. Texts of blanks alone are one
    token. An empty table gives no rows, other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    slim = own.select("doc_id", F.col("text").cast("binary").alias("text"), h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    return slim.mapInArrow(_run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    past = lambda s, mark, at: F.substring(s, at, F.length(s)) if mark is None else F.substring(s, at + len(mark), F.length(s))
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    rest = past(output, None, F.length(first) + 1)
    cut = F.instr(rest, second)
    a, rest = F.substring(rest, F.lit(1), cut - 1), past(rest, PREFIX, cut)
    cut = F.instr(rest, F.lit(MIDDLE))
    b, middle = F.substring(rest, F.lit(1), cut - 1), past(rest, MIDDLE, cut)
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def digests(made: DataFrame) -> DataFrame:
    """``made`` by ``transform``, with hashes of the output and of the text read back from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
