"""License scans: MinHash bands over overlapping windows find templates, exact containment decides.

Words are runs of ASCII letters and digits and of other non-ASCII characters, lower-cased; shingles have
five words. A template of s shingles is looked for in windows of m shingles, m the largest power of
two that is at most s / 2 (at least 1), half overlapping. At least one window of a place that holds
80 % of a template holds 80 % of that window's shingles, a Jaccard similarity of 2/3 to one of the
template's own windows; BANDS bands of BAND_ROWS minima then collide with probability
1 - (1 - (2/3)^2)^12 > 0.999. A window of an exact copy always collides.

What is found is verified over the whole text: the containment is the largest share of the template's
distinct shingles in any stretch of 5/4 of the template's length. It must be at least PERCENT.

Nothing is shuffled: every text is scanned in one piece, wherever it is. Templates are few and travel
with the code. Null and empty texts, and texts of fewer than five words, match nothing; a template of
fewer than five words never matches. Repeated rows and null ids are scanned like any other.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.license_texts import TEMPLATES
from folioflow.llm.shared import mix, shingle_hashes, text_chunks, word_hashes

WORDS = 5
PERCENT = 80
BANDS, BAND_ROWS = 12, 2


def _fold() -> np.ndarray:
    """Bytes that are no part of a word count as spaces."""
    table = np.full(256, ord(" "), np.uint8)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(low) : ord(high) + 1] = np.arange(ord(low), ord(high) + 1)
    table[128:] = np.arange(128, 256)
    return table


_WORD_BYTES = _fold()


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints of all rows in order, and each row's number; none in fewer than five words."""
    words, counts = word_hashes(column, _WORD_BYTES)
    hashes, per_row = shingle_hashes(words, counts, WORDS)
    short = counts < WORDS
    if short.any():
        hashes = hashes[~np.repeat(short, per_row)]
        per_row = np.where(short, 0, per_row)
    return hashes, per_row


def window_size(size: int) -> int:
    return 1 << max(0, (size // 2).bit_length() - 1)


def band_keys(hashes: np.ndarray, size: int, starts: np.ndarray) -> list[np.ndarray]:
    """For each band the keys of the windows of `size` shingles at `starts`."""
    keys = []
    for band in range(BANDS if size > 1 else 1):
        key = np.full(len(starts), band, np.uint64)
        for row in range(BAND_ROWS if size > 1 else 1):
            least = mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (band * BAND_ROWS + row + 1) % (1 << 64)))
            width = 1
            while width < size:  # minima of twice the width, from two halves
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            key = mix(key * np.uint64(0x100000001B3) + least[starts])
        keys.append(key)
    return keys


class Templates:
    """Shingle sets of the templates and, by window size, the band keys that lead to them."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.sets: list[np.ndarray] = []
        places: dict[int, list[dict[int, set[int]]]] = {}
        for number, name in enumerate(self.names):
            hashes, _ = shingles(pa.array([texts[name]]))
            self.sets.append(np.unique(hashes))
            if not len(hashes):
                continue
            size = window_size(len(hashes))
            held = places.setdefault(size, [defaultdict(set) for _ in range(BANDS)])
            starts = np.arange(len(hashes) - size + 1)
            for band, keys in enumerate(band_keys(hashes, size, starts)):
                for key in keys.tolist():
                    held[band][key].add(number)
        #: window size -> for each band the sorted keys, and the templates of each key
        self.bands = {
            size: [(np.array(sorted(band), np.uint64), [band[k] for k in sorted(band)]) for band in held]
            for size, held in places.items()
        }

    def candidates(self, hashes: np.ndarray, per_row: np.ndarray) -> set[tuple[int, int]]:
        """(row, template) pairs of which some window of the row's shingles shares a band key."""
        found: set[tuple[int, int]] = set()
        for size, bands in self.bands.items():
            starts, row = windows(per_row, size)
            if not len(starts):
                continue
            for keys, (known, templates) in zip(band_keys(hashes, size, starts), bands, strict=False):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hits = np.flatnonzero(known[at] == keys)
                for r, place in zip(row[hits].tolist(), at[hits].tolist(), strict=True):
                    found.update((r, t) for t in templates[place])
        return found


def windows(per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of half-overlapping windows within each text, the last one at its end, and their texts' numbers."""
    step = max(1, size // 2)
    whole = np.where(per_row >= size, (per_row - size) // step + 1, 0)
    tail = (per_row > size) & ((per_row - size) % step > 0)
    count = whole + tail
    row = np.repeat(np.arange(len(per_row)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(per_row) - per_row
    return begin[row] + np.minimum(number * step, per_row[row] - size), row


def best_containment(hashes: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """(shingles of the template, start) of the stretch that holds most of it; the first of equals."""
    width = len(template) + -(-len(template) // 4)
    at = np.searchsorted(template, hashes)
    at[at == len(template)] = 0
    places = np.flatnonzero(template[at] == hashes)
    kinds = at[places].tolist()
    places = places.tolist()
    best, start, stop, counts = (0, 0), 0, 0, defaultdict(int)
    for start in range(len(places)):
        while stop < len(places) and places[stop] < places[start] + width:
            counts[kinds[stop]] += 1
            stop += 1
        held = len(counts)
        if held > best[0]:
            best = (held, places[start])
        counts[kinds[start]] -= 1
        if not counts[kinds[start]]:
            del counts[kinds[start]]
    return best


def license_matches(
    documents: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, template, containment, start_word) for each text and template that it holds."""
    texts = TEMPLATES if templates is None else templates

    def scan(batches):
        known = Templates(texts)
        for piece in text_chunks(batches):
            hashes, per_row = shingles(piece.column("text"))
            stops = np.cumsum(per_row)
            rows, names, shares, starts = [], [], [], []
            for r, t in sorted(known.candidates(hashes, per_row)):
                held, start = best_containment(hashes[stops[r] - per_row[r] : stops[r]], known.sets[t])
                if 100 * held >= percent * len(known.sets[t]):
                    rows.append(r)
                    names.append(known.names[t])
                    shares.append(held / len(known.sets[t]))
                    starts.append(start)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()),
                    pa.array(shares, pa.float64()), pa.array(starts, pa.int64()),
                ],
                names=["doc_id", "template", "containment", "start_word"],
            )

    table = documents.select(F.col("doc_id").cast("bigint"), "text")
    return table.mapInArrow(scan, "doc_id bigint, template string, containment double, start_word bigint")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ",\n    ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
_SHINGLES = f"array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')"

#: Brute force: every template against every stretch of every text.
OP4_SQL = f"""
WITH t(template, text) AS (VALUES
    {_ROWS}
), ts AS (
  SELECT DISTINCT template, {_SHINGLES} AS shingle FROM (
    SELECT template, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM (SELECT template, {_WORDS} AS w FROM t))
), size AS (
  SELECT template, count(*) AS s, count(*) + CAST(ceil(count(*) / 4) AS BIGINT) AS width FROM ts GROUP BY template
), ds AS (
  SELECT doc_id, i - 1 AS place, {_SHINGLES} AS shingle FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM (
      SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL))
), hits AS (
  SELECT doc_id, template, place, shingle FROM ds JOIN ts USING (shingle)
), held AS (
  SELECT a.doc_id, a.template, a.place, count(DISTINCT b.shingle) AS n
  FROM (SELECT DISTINCT doc_id, template, place FROM hits) a JOIN size z ON z.template = a.template
  JOIN hits b ON b.doc_id = a.doc_id AND b.template = a.template AND b.place >= a.place AND b.place < a.place + z.width
  GROUP BY ALL
), best AS (
  SELECT doc_id, template, max(n) AS n, arg_max(place, n * 1000000000 - place) AS start_word FROM held GROUP BY ALL
)
SELECT doc_id, template, n / s AS containment, start_word FROM best JOIN size USING (template)
WHERE 100 * n >= {PERCENT} * s
"""
