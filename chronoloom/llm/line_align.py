"""Line dedup by pairwise alignment.

Lines are compared by a hash of their trimmed, lower-cased text; blank lines are passed over. A run is the shortest
sequence of successive lines, from any line on or up to any line, with at least LEAST_WORDS words; the runs within a block
of that many words that two documents share cover it. For each run that several documents have, the one with the least
doc_id owns it; every other document that has it makes a pair with the owner. So whatever a document shares with any
earlier one, it shares with the owners that it is paired with; pairs grow with the shared runs and not with the square of
their groups, and no line is too frequent or too short to count. Each pair is aligned with patience diff over the runs that
they share: those that occur once on either side anchor the alignment (longest increasing sequence), the gaps are aligned in
turn. What crosses that alignment is aligned again, against the owner read backwards and forwards by turns, until nothing is
left. The lines of aligned runs are deleted from the later document. Documents are compared as they came, so the first
document with a run always keeps it, but for lines that are in a run of a yet earlier one.

Only hashes and places of runs travel, those of the owner beside those of each document that shares them; texts are read
once for hashing and once for the deletions.

Defined cases: documents with a null doc_id or null text are left as they are; blank lines are neither compared nor
deleted; rows that share a doc_id are never compared with each other, and equal rows get equal results; a document all of
whose words go is left with what blank lines remain, and line_dedup_stage drops it, while texts that had no words before
stay; other columns pass through, whatever their names.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD, discard, fresh_name, materialize, split_by_ids

#: Words that a common block has at least.
LEAST_WORDS = 5
#: Rows in a batch that goes back to the JVM.
_ROWS = 100_000
_HALF = 1 << 63


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest sequence of pairs, given in order of the first, that increases in the second."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        at_a: dict[int, list[int]] = {}
        at_b: dict[int, list[int]] = {}
        for i in range(i0, i1):
            at_a.setdefault(a[i], []).append(i)
        for j in range(j0, j1):
            if b[j] in at_a:
                at_b.setdefault(b[j], []).append(j)
        anchors = sorted((at_a[h][0], js[0]) for h, js in at_b.items() if len(js) == 1 and len(at_a[h]) == 1)
        if not anchors:  # no line is unique on both sides: the k-th occurrences pair up
            anchors = sorted(p for h, js in at_b.items() for p in zip(at_a[h], js, strict=False))
        if not anchors:
            continue
        anchors = _increasing(anchors)
        out += anchors
        last_i, last_j = i0, j0
        for i, j in [*anchors, (i1, j1)]:
            if last_i < i and last_j < j:
                todo.append((last_i, i, last_j, j))
            last_i, last_j = i + 1, j + 1
    return sorted(out)


def runs(words: list[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Begin and end of the runs from and up to each line, by the lines' numbers of words; no line is blank."""
    out, end, size = [], 0, 0
    for k in range(len(words)):
        while size < least_words and end < len(words):
            size += words[end]
            end += 1
        if size < least_words:
            break
        out.append((k, end))
        size -= words[k]
    begin = size = 0
    for end in range(1, len(words) + 1):
        size += words[end - 1]
        while size - words[begin] >= least_words:
            size -= words[begin]
            begin += 1
        if size >= least_words:
            out.append((begin, end))
    return sorted(set(out))


def text_runs(text: str, least_words: int = LEAST_WORDS) -> dict[int, tuple[list[int], list[int]]]:
    """For each different run of a text, by its hash: where it begins, among the lines that aren't blank, and the numbers of its lines, for each time that it occurs."""
    number, size, digest = [], [], []
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if words := len(line.split()):
            number.append(n)
            size.append(words)
            digest.append(xxhash.xxh64_intdigest(line.strip().lower()) - _HALF)
    single = not size or min(size) >= least_words
    packed = b"" if single else np.array(digest, np.int64).tobytes()
    found: dict[int, tuple[list[int], list[int]]] = {}
    for k, end in zip(range(len(size)), range(1, len(size) + 1), strict=True) if single else runs(size, least_words):
        h = digest[k] if end == k + 1 else xxhash.xxh64_intdigest(packed[8 * k : 8 * end]) - _HALF
        at, lines = found.setdefault(h, ([], []))
        at.append(k)
        lines += number[k:end]
    return found


def aligned_lines(shared: list[tuple[list[int], list[int], list[int]]]) -> set[int]:
    """Lines of the later document in runs that are aligned with the owner's. shared: for each run, its places and lines in the later document and its places in the owner."""
    mine = sorted((k, r, lines[i * n : i * n + n]) for r, (at, lines, _) in enumerate(shared) for n in [len(lines) // len(at)] for i, k in enumerate(at))
    theirs = [r for _, r in sorted((k, r) for r, (_, _, owned) in enumerate(shared) for k in owned)]
    gone: set[int] = set()
    while mine:
        hit = {i for i, _ in patience([r for _, r, _ in mine], theirs)}
        for i in hit:
            gone.update(mine[i][2])
        mine = [x for i, x in enumerate(mine) if i not in hit]
        theirs.reverse()  # what crosses in one direction is in order in the other: of n runs, two turns align the root of n at least
    return gone


def run_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), h, at, lines: a row for each different run of each document; a written table."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    ints = pa.list_(pa.int32())

    def rows(ids, th, which, hs, at, lines):
        which = pa.array(which, pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(which), th.take(which), pa.array(hs, pa.int64()), pa.array(at, ints), pa.array(lines, ints)], ["doc_id", "th", "h", "at", "lines"])

    def run(batches):
        for b in batches:
            ids, th = b.column("doc_id"), b.column("th")
            which, hs, at, lines = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for h, (k, n) in text_runs(text, least_words).items():
                    which.append(i)
                    hs.append(h)
                    at.append(k)
                    lines.append(n)
                    if len(hs) >= _ROWS:
                        yield rows(ids, th, which, hs, at, lines)
                        which, hs, at, lines = [], [], [], []
            yield rows(ids, th, which, hs, at, lines)

    return materialize(texts.mapInArrow(run, f"doc_id {doc_type}, th bigint, h bigint, at array<int>, lines array<int>"), "la-runs")


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """d_id, d_th, gone (sorted line numbers) for each document that loses lines; a written table."""
    table = run_table(docs, least_words)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    owners = table.groupBy("h").agg(F.min(F.struct("doc_id", "th", "at")).alias("o"), F.max("doc_id").alias("top")).where("o.doc_id < top")
    owners = materialize(owners.select("h", F.col("o.doc_id").alias("owner"), F.col("o.th").alias("owner_th"), F.col("o.at").alias("owned")), "la-owners")
    shared = table.join(owners, "h").where("doc_id > owner")
    # a document's shared runs, once each however often its row is repeated: no more than the document has
    by_later = shared.groupBy("doc_id", "th").agg(F.collect_set(F.struct("owner", "owner_th", "at", "lines", "owned")).alias("shared"))

    def run(batches):
        for b in batches:
            gone = []
            for k in range(b.num_rows):
                by_owner: dict = {}
                for x in b.column("shared")[k].as_py():
                    by_owner.setdefault((x["owner"], x["owner_th"]), []).append((x["at"], x["lines"], x["owned"]))
                gone.append(sorted(set().union(*map(aligned_lines, by_owner.values()))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(gone, pa.list_(pa.int32()))], ["d_id", "d_th", "gone"])

    out = materialize(by_later.mapInArrow(run, f"d_id {doc_type}, d_th bigint, gone array<int>"), "la-gone")
    discard(table, owners)
    return out


def dedup_lines(docs: DataFrame, gone_col: str = "gone", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with text reduced and the deleted line numbers in gone_col (null: none deleted)."""
    gone = deletions(docs, least_words)
    th, g = fresh_name(docs, "line_th"), fresh_name(docs, gone_col)
    touched, rest = split_by_ids(docs, "doc_id", gone.select("d_id").distinct())  # only texts that lose lines are shuffled
    gone = gone.select(F.col("d_id").alias("__d_id"), F.col("d_th").alias("__d_th"), F.col("gone").alias(g))
    joined = touched.withColumn(th, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col("__d_id")) & (F.col(th) == F.col("__d_th")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(g), i))
    joined = joined.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))).drop(th, "__d_id", "__d_th")
    return joined.unionByName(rest.withColumn(g, F.lit(None).cast("array<int>")))


def line_digest(docs: DataFrame) -> DataFrame:
    """A row per document: lines before, lines deleted, and length and md5 of what is left."""
    had = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    out = dedup_lines(had)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"), F.length("text").cast("bigint").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("md5_left"))


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts without the lines deleted; documents that lost all their words go. n_chars follows the text."""
    gone = fresh_name(docs, "gone")
    out = dedup_lines(docs, gone).where(F.col(gone).isNull() | (F.regexp_count("text", F.lit(WORD)) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
