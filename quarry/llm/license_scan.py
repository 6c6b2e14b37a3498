"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans.

Templates are cut into words; of every ``window`` neighbouring runs of ``k`` words
the least hash is kept, in an inverted index from hash to (template, place).  A
document keeps hashes by the same rule, so any shared stretch of k + window - 1
words meets the index.  Hits of one template on neighbouring diagonals that go on
in both form a candidate (one that starts over is another copy), and an alignment of the template's words with the document's words
inside a band around them counts matched words.  Templates are a parameter of
the scan, a list that goes to each task; documents are read one at a time and
nothing is shuffled, so no frequent licence makes a hot group.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.license_templates import TEMPLATES

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_RUN = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_at(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text (ASCII letters lower-cased, runs of letters, digits and non-ASCII) and its lower-case bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    return _WORD.findall(data), data


class Index:
    """Templates' words by number and the inverted index of their kept runs."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.k, self.window = k, window
        self.names = list(templates)
        self.words = [words_at(t)[0] for t in templates.values()]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.ids = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.ids):
            for p in self.kept(ids):
                self.post[int(self.runs(ids)[p])].append((t, p))
        self.known = np.array(sorted(self.post), np.uint64)

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of k words; the greatest where a word is in no template, so that it is never kept."""
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for j in range(self.k):
                part = ids[j : j + n]
                out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
                known &= part > 0
        return np.where(known, out, _NO_RUN)

    def kept(self, ids: np.ndarray) -> list[int]:
        h = self.runs(ids)
        if not len(h):
            return []
        w = min(self.window, len(h))
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
        return at[h[at] != _NO_RUN].tolist()


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Pairs (template place, document place) of a longest common subsequence within band of the diagonal; nearest to it on ties."""
    n, width = len(template), 2 * band + 1
    best = np.zeros((n + 1, width + 2), np.int32)  # row i: the first i template words; column b: document place i + diagonal + b - band
    for i in range(1, n + 1):
        row, up = best[i], best[i - 1]
        t = template[i - 1]
        for b in range(1, width + 1):
            j = i - 1 + diagonal + b - 1 - band
            hit = up[b] + 1 if 0 <= j < len(doc) and doc[j] == t else 0
            row[b] = max(hit, row[b - 1], up[b + 1])
    pairs, i, b = [], n, int(np.argmax(best[n][1 : width + 1])) + 1
    while i > 0 and b > 0:
        j = i - 1 + diagonal + b - 1 - band
        if 0 <= j < len(doc) and doc[j] == template[i - 1] and best[i][b] == best[i - 1][b] + 1:
            pairs.append((i - 1, j))
            i -= 1
        elif best[i][b] == best[i][b - 1]:
            b -= 1
        elif b + 1 <= width and best[i][b] == best[i - 1][b + 1]:
            i, b = i - 1, b + 1
        else:
            i -= 1
    return pairs[::-1]


def chains(hits: list[tuple[int, int]], band: int) -> list[list[tuple[int, int]]]:
    """Hits (document place, template place) dealt into runs that rise in both, each within band diagonals of the one before."""
    out, live = [], []
    for p, q in sorted(hits):
        live = [c for c in live if c[-1][0] - c[-1][1] >= p - q - band or c[-1][0] == p]
        fit = [c for c in live if c[-1][0] < p and c[-1][1] < q and abs((c[-1][0] - c[-1][1]) - (p - q)) <= band]
        if fit:
            min(fit, key=lambda c: abs((c[-1][0] - c[-1][1]) - (p - q))).append((p, q))
        else:
            out.append([(p, q)])
            live.append(out[-1])
    return out


def copies(template: np.ndarray, doc: np.ndarray, hits: list[tuple[int, int]], k: int, band: int, least: float) -> list[list[tuple[int, int]]]:
    """Alignments of at least ``least`` words that share no stretch of the document.

    A candidate is aligned between the hits of its neighbours first and, if too few
    words match, between the copies found so far.  The hits that a copy doesn't cover
    are dealt again.
    """
    found: list[list[tuple[int, int]]] = []
    todo = chains(hits, band)
    while todo:
        todo.sort(key=lambda c: (-len(c), c[0]))
        mine = todo.pop(0)
        (p0, _), (p1, _) = mine[0], mine[-1]
        if any(f[0][1] <= p1 + k - 1 and p0 <= f[-1][1] for f in found):
            mine = [h for h in mine if all(h[0] + k - 1 < f[0][1] or h[0] > f[-1][1] for f in found)]
            if mine:
                cuts = sorted(f[0][1] for f in found)
                parts: dict[int, list] = defaultdict(list)
                for h in mine:
                    parts[int(np.searchsorted(cuts, h[0]))].append(h)
                todo += parts.values()
            continue
        marks = [p - q for p, q in mine]
        mid, wide = (min(marks) + max(marks)) // 2, band + (max(marks) - min(marks) + 1) // 2
        lo = max([0, *(f[-1][1] + 1 for f in found if f[-1][1] < p0)])
        hi = min([len(doc), *(f[0][1] for f in found if f[0][1] > p1)])
        near = (max([lo, *(c[-1][0] + k for c in todo if c[-1][0] + k <= p0)]), min([hi, *(c[0][0] for c in todo if c[0][0] >= p1 + k)]))
        for a, z in dict.fromkeys([near, (lo, hi)]):
            a, z = max(a, mid - wide), min(z, mid + wide + len(template))
            pairs = [(i, j + a) for i, j in align(template, doc[a:z], mid - a, wide)]
            if len(pairs) >= least:
                found.append(pairs)
                rest = [h for h in mine if h[0] + k - 1 < pairs[0][1] or h[0] > pairs[-1][1]]
                for side in ([h for h in rest if h[0] < pairs[0][1]], [h for h in rest if h[0] > pairs[-1][1]]):
                    todo += chains(side, band)
                break
    return found


def scan_text(text: str | None, index: Index, band: int, coverage: float) -> list[dict]:
    """Matches of one text: license, coverage, matched words, spans [start, end) in bytes of the UTF-8 text; best of those that overlap."""
    words, data = words_at(text)
    ids = np.fromiter(map(index.number.get, words, [0] * len(words)), np.int64, len(words))
    runs = index.runs(ids)
    if not len(runs) or not np.isin(runs, index.known).any():
        return []
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in index.kept(ids):
        for t, q in index.post.get(int(runs[p]), ()):
            hits[t].append((p, q))
    found, place = [], [m.span() for m in _WORD.finditer(data)]
    for t, own in hits.items():
        for pairs in copies(index.ids[t], ids, own, index.k, band, coverage * len(index.ids[t])):
            spans: list[list[int]] = []
            for _, j in pairs:
                if spans and spans[-1][2] + 1 == j:
                    spans[-1][1:] = [place[j][1], j]
                else:
                    spans.append([*place[j], j])
            found.append({"license": index.names[t], "coverage": len(pairs) / len(index.ids[t]), "matched": len(pairs), "spans": [{"start": s[0], "end": s[1]} for s in spans]})
    found.sort(key=lambda m: (-m["matched"], -m["coverage"], m["license"], m["spans"][0]["start"]))
    taken: list[dict] = []
    for m in found:  # a longer template hides what it covers
        if all(m["spans"][-1]["end"] <= o["spans"][0]["start"] or m["spans"][0]["start"] >= o["spans"][-1]["end"] for o in taken):
            taken.append(m)
    return sorted(taken, key=lambda m: m["spans"][0]["start"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 3, window: int = 3, band: int = 8, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched, spans: a row for each match, in the order of the text.

    A match covers at least ``coverage`` of its template's words; templates shorter
    than k words can't match.  Null and empty texts, and an empty table, give no
    rows; repeated rows match alike; other columns are not read.
    """
    templates = dict(TEMPLATES if templates is None else templates)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, k, window)
        schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            rows = [{"doc_id": d} | m for i, d in enumerate(ids) for m in scan_text(texts[i].as_py(), index, band, coverage)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(made, "doc_id long, license string, coverage double, matched int, spans array<struct<start:long,end:long>>")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
