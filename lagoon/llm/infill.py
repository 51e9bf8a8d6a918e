"""Fill-in-the-middle: documents cut in three and put together again around sentinels.

A table-driven automaton over bytes does all the reading. Its state says how many
continuation bytes a character still lacks and how much of a sentinel is there; a
transition's entry holds the next state and two flags, a unit (code point) that
starts and a sentinel that is complete. After any four bytes the state no longer
depends on what came before them, so a text is scanned in blocks side by side, each
from four bytes before its own.

1. One scan counts the flagged transitions of every block: units and sentinels.
2. Where a document is cut follows from its id and its number of units. The blocks
   that hold a cut are found in the running counts and run through the automaton
   again, up to the unit that the cut stands before.

Defined cases: a null or empty text is plain, with 0 units and an empty output; a
null id is cut as the id '' would be; rows are independent, so repeated rows repeat
their results; an empty table gives no rows; further columns are ignored, whatever
their names; a text of any length is cut whole; a byte that isn't UTF-8 is a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon.llm.scan import chunks, flatten
from lagoon.llm.shared import arrow_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block, and those read before it.
BLOCK, BEFORE = 512, 4

# --- the automaton ---------------------------------------------------------

_OTHER, _OPEN, _LETTER, _CLOSE, _MORE, _TWO, _THREE, _FOUR = range(8)
#: States: between characters, after '<', after '<' and a letter, and 1 to 3 continuation bytes lacking.
_GROUND, _OPENED, _LETTERED, _LACKS = 0, 1, 2, 2
_UNIT, _SENTINEL = 8, 16


def byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[0x80:0xC0], kind[0xC2:0xE0], kind[0xE0:0xF0], kind[0xF0:0xF5] = _MORE, _TWO, _THREE, _FOUR
    for byte, c in ((b"<", _OPEN), (b">", _CLOSE), *((bytes([s[1]]), _LETTER) for s in (PREFIX, SUFFIX, MIDDLE))):
        kind[byte[0]] = c
    return kind


def transitions() -> np.ndarray:
    """table[state * 8 + class]: next state, with the flags of the transition."""
    table = np.zeros(8 * 8, np.uint8)
    for state in range(6):
        for kind in range(8):
            if kind == _MORE and state > _LACKS:  # the character goes on
                table[state * 8 + kind] = state - 1 if state > _LACKS + 1 else _GROUND
                continue
            after = {_OPEN: _OPENED, _TWO: _LACKS + 1, _THREE: _LACKS + 2, _FOUR: _LACKS + 3}.get(kind, _GROUND)
            if state == _OPENED and kind == _LETTER:
                after = _LETTERED
            done = _SENTINEL if state == _LETTERED and kind == _CLOSE else 0
            table[state * 8 + kind] = after | _UNIT | done
    return table


_KINDS, _TABLE = byte_classes(), transitions()


@dataclass
class Blocks:
    """Blocks of texts: each one's bytes' classes as a column, behind those of the four bytes before it."""

    starts: np.ndarray
    ends: np.ndarray
    columns: np.ndarray

    @staticmethod
    def of(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, floors: np.ndarray) -> "Blocks":
        """`floors` are the starts of the blocks' texts; what lies before those or after a block's end reads as a plain character."""
        at = starts[None, :] - BEFORE + np.arange(BEFORE + int((ends - starts).max(initial=0)))[:, None]
        inside = (at >= floors) & (at < ends)
        columns = np.where(inside, kinds[np.clip(at, 0, max(len(kinds) - 1, 0))], np.uint8(_OTHER)) if len(kinds) else np.zeros(at.shape, np.uint8)
        return Blocks(starts, ends, columns)

    def run(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the block, flagged transitions) at each byte of the blocks, side by side."""
        state = np.zeros(len(self.starts), np.uint8)
        for k, kinds in enumerate(self.columns):
            moved = _TABLE[(state & 7) * 8 + kinds]
            state = moved
            if k >= BEFORE:
                yield k - BEFORE, np.where(self.starts + (k - BEFORE) < self.ends, moved, np.uint8(0))


def count(kinds: np.ndarray, off: np.ndarray) -> tuple[Blocks, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts, the first block of each text, and the units and sentinels of each block. (first pass)"""
    sizes = np.diff(off)
    per = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    of = np.repeat(np.arange(len(sizes)), per)
    starts = off[of] + (np.arange(first[-1]) - first[of]) * BLOCK
    blocks = Blocks.of(kinds, starts, np.minimum(starts + BLOCK, off[of + 1]), off[of])
    units, found = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for _, moved in blocks.run():
        units += (moved & _UNIT) != 0
        found += (moved & _SENTINEL) != 0
    return blocks, first, units, found


def locate(kinds: np.ndarray, off: np.ndarray, blocks: Blocks, first: np.ndarray, units: np.ndarray, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Where unit number `unit` (from 0) of text number `text` starts; the text's end for its number of units. (second pass)"""
    running = np.concatenate([[0], np.cumsum(units)])
    wanted = running[first[text]] + unit
    where = np.minimum(np.searchsorted(running, wanted, "right") - 1, np.maximum(first[text + 1] - 1, 0))
    out = off[text + 1].copy()
    some = np.flatnonzero(unit < running[first[text + 1]] - running[first[text]])
    if len(some):
        block, left = where[some], (wanted - running[where])[some]
        seen = np.full(len(some), -1)
        for k, moved in Blocks.of(kinds, blocks.starts[block], blocks.ends[block], off[text[some]]).run():
            starts = (moved & _UNIT) != 0
            seen += starts
            here = starts & (seen == left)
            out[some[here]] = blocks.starts[block[here]] + k
    return out


# --- documents -------------------------------------------------------------


@dataclass(frozen=True)
class Rates:
    """Of 100 documents: so many stay plain, and of the others so many have their suffix first."""

    plain: int = 10
    suffix_first: int = 20
    seed: str = "1"


def draws(ids: list, seed: str) -> np.ndarray:
    """Four numbers of 32 bits for each id, by its hash alone."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def cut(buf: np.ndarray, off: np.ndarray, ids: list, rates: Rates) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(outputs, forms, units, prefix units, middle units) of texts; the last two are -1 where a text stays plain."""
    kinds = _KINDS[buf]
    blocks, first, units, found = count(kinds, off)
    sums = np.concatenate([[0], np.cumsum(units)])
    n = sums[first[1:]] - sums[first[:-1]]
    marks = np.concatenate([[0], np.cumsum(found)])
    h = draws(ids, rates.seed)
    plain = (n == 0) | (marks[first[1:]] > marks[first[:-1]]) | (h[:, 2] % 100 >= 100 - rates.plain)
    suffix_first = h[:, 3] % 100 < rates.suffix_first
    pair = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cutting = np.flatnonzero(~plain)
    at = locate(kinds, off, blocks, first, units, np.concatenate([cutting, cutting]), np.concatenate([pair[cutting, 0], pair[cutting, 1]])).reshape(2, -1)
    raw, outputs, forms = buf.tobytes(), [], []
    bounds = iter(at.T.tolist())
    for i, stays in enumerate(plain.tolist()):
        a, z = int(off[i]), int(off[i + 1])
        if stays:
            outputs.append(raw[a:z])
            forms.append("plain")
            continue
        p, m = next(bounds)
        parts = (SUFFIX, raw[m:z], PREFIX, raw[a:p]) if suffix_first[i] else (PREFIX, raw[a:p], SUFFIX, raw[m:z])
        outputs.append(b"".join((*parts, MIDDLE, raw[p:m])))
        forms.append("spm" if suffix_first[i] else "psm")
    return outputs, forms, n, np.where(plain, -1, pair[:, 0]), np.where(plain, -1, pair[:, 1] - pair[:, 0])


def transform(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, output, form, n, prefix_chars, middle_chars) for each row; the cuts are null where a text stays plain."""
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "output", "form", "n", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (buf, off) = b.column("id"), flatten(b.column("text"))
            known = ids.to_pylist()
            for i, j in chunks(off):
                outputs, forms, n, prefix, middle = cut(buf[off[i] : off[j]], off[i : j + 1] - off[i], known[i:j], rates)
                cols = [ids.slice(i, j - i), pa.array(outputs, pa.binary()), pa.array(forms, pa.string()), pa.array(n, pa.int64())]
                cols += [pa.array(x, pa.int64(), mask=x < 0) for x in (prefix, middle)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, f"id {id_type}, output binary, form string, n long, prefix_chars long, middle_chars long")
    return made.select(F.col("id").alias(id_col), F.col("output").cast("string").alias("output"), *names[2:])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substring(text, 1, p) AS a, substring(text, p + 1, m - p) AS b, substring(text, m + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
