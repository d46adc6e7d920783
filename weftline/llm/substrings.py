"""Substring dedup: hashed runs of consecutive sentences, joined over all documents; repeats after the first are cut."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, settle

#: A run has so many consecutive sentences, and more only where they have under LEAST_WORDS words: "Yes. No. Yes." is no passage,
#: and such texts repeat by chance (without it, three sentences repeat by chance in 7 % of the documents of check_s).
SENTENCES, LEAST_WORDS = 3, 12
#: A sentence of more words is hashed in pieces as well, so that a passage without marks, or the part of a sentence that a copy
#: shares, is found after any lead-in: the words themselves say where it is cut (pieces()), and each shortest run of two
#: pieces or more with PIECE_RUN words is hashed.
LONG_SENTENCE, PIECE_RUN = 32, 20
#: Of each WINDOW words in a row, the one that hashes least with the word before it ends a piece, of MOST_WORDS at most. Any
#: passage of PIECE_RUN + 2 * WINDOW + 1 = 49 words without a mark then has a run of its own, and all but WINDOW words at its
#: ends goes.
MOST_WORDS, WINDOW = 16, 14

#: A character of a script without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han and their marks) is a word of its own.
_UNSPACED = re.compile(
    rb"(?:\xe0[\xb8-\xbf]|\xe1(?:[\x80\x81\x9e\x9f]|\x82(?=[\x80-\x9f]))|\xe2[\xba-\xbf]|\xe3[\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xef[\xa4-\xab\xbc\xbd])[\x80-\xbf]"
    rb"|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
)
_HIGH = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]|\xe2[\xba-\xbf]")
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_MIXED = re.compile(rb"%b|(?:[^\x20\x09-\x0d\xe0-\xf0]|(?!%b)[\xe0-\xf0])+" % (_UNSPACED.pattern, _UNSPACED.pattern))
#: Where a sentence or a line stops: a mark at the end of a word. Marks of other scripts: Armenian, Arabic, Urdu, Devanagari,
#: Ethiopic; and of those without spaces, Han and full width, Burmese, Khmer, Tibetan.
_STOPS_ASCII = re.compile(rb"[.!?\n](?:(?<=\n)|(?![^\x20\x09-\x0d]))")
_STOPS = re.compile(
    rb"\n|(?:[.!?]|\xd6\x89|\xd8\x9f|\xdb\x94|\xe0\xa5[\xa4\xa5]|\xe1\x8d[\xa2\xa7])(?:(?![^\x20\x09-\x0d])|(?=%b))"
    rb"|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]|\xef\xbd\xa1|\xe1\x81\x8b|\xe1\x9f[\x94\x95]|\xe0\xbc\x8d" % _UNSPACED.pattern
)


def sentences(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, words) of each sentence, in bytes, from its first word to its last.

    A sentence ends after a full stop, exclamation or question mark of any script below, or with its line.
    """
    out = []
    spaced = _is_spaced(text)
    at = 0
    for stop in [*[m.end() for m in (_STOPS_ASCII if text.isascii() else _STOPS).finditer(text)], len(text)]:
        part = text[at:stop]
        if n := len(part.split()) if spaced else sum(1 for _ in _MIXED.finditer(part)):
            out.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip()), n))
        at = stop
    return out


def _is_spaced(text: bytes) -> bool:
    return text.isascii() or not _HIGH.search(text) or not _UNSPACED.search(text)


def pieces(text: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, words) of a long sentence's pieces, or of itself if it has no more than MOST_WORDS words.

    A cut follows each word that has the one least hash of some WINDOW words in a row, so it hangs on those words alone and
    pieces have up to WINDOW words. Where words repeat so that none is least, the last least one of each MOST_WORDS ends a piece.
    """
    n = len(words)
    if n <= MOST_WORDS:
        return [(words[0][0], words[-1][1], n)]
    plain = [text[a:b] for a, b in words]
    hashes = [1 << 32, *map(zlib.crc32, plain[1:], map(zlib.crc32, plain))]
    cuts, i = {n - 1}, 1
    while i <= n - WINDOW:
        near = hashes[i : i + WINDOW]
        least = min(near)
        if near.count(least) > 1:
            i += 1
            continue
        at = i + near.index(least)
        cuts.add(at)
        # the next window to look at is the first with a hash as small, or that without this one
        i = next((j - WINDOW + 1 for j in range(i + WINDOW, min(at + WINDOW, n)) if hashes[j] <= least), at + 1)
    out, start = [], 0
    for cut in sorted(cuts):
        while cut - start >= MOST_WORDS:
            at = min(range(start, start + MOST_WORDS), key=lambda i: (hashes[i], -i))
            out.append((words[start][0], words[at][1], at - start + 1))
            start = at + 1
        out.append((words[start][0], words[cut][1], cut - start + 1))
        start = cut + 1
    return out


def runs(sizes: list[int], least: int, words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest run of least parts with so many words from each part on, and up to each.

    sizes has the parts' words. So a stretch of parts is covered by runs of its own, whatever stands around it.
    """
    found = set()
    n = len(sizes)
    last, total = -1, 0
    for first in range(n):  # the window only moves on, as taking a part off its front never lets it end earlier
        while last + 1 < n and (last - first + 1 < least or total < words):
            last += 1
            total += sizes[last]
        if last - first + 1 < least or total < words:
            break
        found.add((first, last))
        total -= sizes[first]
    first, total = n, 0
    for last in range(n - 1, -1, -1):
        while first > 0 and (last - first + 1 < least or total < words):
            first -= 1
            total += sizes[first]
        if last - first + 1 < least or total < words:
            break
        found.add((first, last))
        total -= sizes[last]
    return sorted(found)


def hashed_runs(text: bytes) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each run of sentences, and of each run of pieces of a long sentence; in bytes.

    The hash is 96 bits of the words, white space taken as one space; runs of pieces don't equal runs of sentences.
    """
    parts = sentences(text)
    own = [xxhash.xxh3_128_digest(b" ".join(text[a:b].split())) for a, b, _ in parts]
    out = [(_hash96(b"".join(own[i : j + 1])), parts[i][0], parts[j][1]) for i, j in runs([n for _, _, n in parts], SENTENCES, LEAST_WORDS)]
    spaced = None
    for start, end, n in parts:
        if n > LONG_SENTENCE:
            spaced = _is_spaced(text) if spaced is None else spaced
            cut = pieces(text, [m.span() for m in (_WORDS if spaced else _MIXED).finditer(text, start, end)])
            plain = [b" ".join(text[a:b].split()) for a, b, _ in cut]
            out += [(_hash96(b" ".join(plain[i : j + 1])), cut[i][0], cut[j][1]) for i, j in runs([n for _, _, n in cut], 2, PIECE_RUN)]
    return out


def _hash96(data: bytes) -> int:
    return xxhash.xxh3_128_intdigest(data) >> 32


def _signed(h: int) -> int:
    return (h >> 32) - (1 << 63)


def _runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, h, more, start, end): where each different run of each text stands first; h is null where it stands again.

    Stretches that stand again are given as few as they are: those that touch or overlap are one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, rest, places, owners = [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                seen, again = set(), []
                for h, start, end in hashed_runs(text):
                    if h in seen:
                        again.append((start, end))
                        continue
                    seen.add(h)
                    hashes.append(_signed(h))
                    rest.append((h & 0xFFFFFFFF) - (1 << 31))
                    places.append((start, end))
                    owners.append(i)
                for place in _merged(again):
                    hashes.append(None)
                    rest.append(None)
                    places.append(place)
                    owners.append(i)
            at = pa.array(owners, pa.int32())
            columns = [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(hashes, pa.int64()), pa.array(rest, pa.int32()), *(pa.array([p[k] for p in places], pa.int32()) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "h", "more", "start", "end"])

        return turn

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(per_batch(make), f"doc_id {kind}, mark long, h long, more int, start int, end int")


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end) of each run that a document of lesser doc_id has too, or its own text has before.

    Texts are read and hashed once; the runs are written out with their places. They are counted with partial sums before the
    shuffle, and both sides of the join back are plain shuffles, of which adaptive execution (spark.sql.adaptive.skewJoin, on
    by default) splits a partition that boilerplate of very many documents swells.
    """
    runs = settle(_runs_of(docs), "runs")
    counted = runs.filter("h is not null").groupBy("h", "more").agg(F.min("doc_id").alias("origin"), F.count(F.lit(1)).alias("n"))
    twice = counted.filter("n > 1").select("h", "more", "origin")
    across = runs.join(twice, ["h", "more"]).filter(~F.col("doc_id").eqNullSafe(F.col("origin")))
    within = runs.filter("h is null")
    return across.select("doc_id", "mark", "start", "end").unionByName(within.select("doc_id", "mark", "start", "end"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_sentences, n_removed (those cut as a whole), removed (start:end in code
    points, comma-joined) and clean_text, without the sentences, or pieces of long ones, of any run that is not the first.

    The first is that of the least doc_id, then within a text the earliest. White space within a sentence doesn't tell runs
    apart, case and marks do. A text of under SENTENCES sentences or LEAST_WORDS words has only runs of pieces, a short one none; a text of any
    length is cut as a whole. Null text stays null, empty stays empty, an empty table gives none. Rows of one doc_id are
    versions of one document and not repeats of each other; without an id they come last. A text from which all is cut is
    left with white space. Copies of a row come back each; other columns aren't read.
    """
    bad = repeated_stretches(docs).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("bad"))
    bad = bad.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    joined = marked.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "bad")

    def make():
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, gone, spans, clean = [], [], [], []
            bads, there = batch.column("bad").to_pylist(), batch.column("text").is_valid().to_pylist()
            for text, known, bad in zip(as_bytes(batch.column("text")), there, bads, strict=True):
                parts = sentences(text)
                cut = _merged([(b["start"], b["end"]) for b in bad or ()])
                cut = _bridged(text, cut)
                left, listed = _without(text, cut)
                counts.append(len(parts))
                gone.append(_inside(parts, cut))
                spans.append(listed)
                clean.append(left.decode("utf-8", "replace") if known else None)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string()), pa.array(clean, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "n_removed", "removed", "clean_text"])

        return turn

    return joined.mapInArrow(per_batch(make), f"doc_id {kind}, n_sentences long, n_removed long, removed string, clean_text string")


def _bridged(text: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """cut, stretches with only white space between them taken as one."""
    out: list[tuple[int, int]] = []
    for start, end in cut:
        if out and not text[out[-1][1] : start].strip():
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _inside(parts: list[tuple[int, int, int]], cut: list[tuple[int, int]]) -> int:
    """How many of parts lie in a stretch of cut; both are in order."""
    n = i = 0
    for start, end, _ in parts:
        while i < len(cut) and cut[i][1] < end:
            i += 1
        n += i < len(cut) and cut[i][0] <= start
    return n


def _without(text: bytes, cut: list[tuple[int, int]]) -> tuple[bytes, str]:
    """text without the stretches, and where they stood."""
    kept, at, chars, listed = [], 0, 0, []
    for start, end in cut:
        kept.append(text[at:start])
        chars += len(text[at:start].decode("utf-8", "replace"))
        size = len(text[start:end].decode("utf-8", "replace"))
        listed.append(f"{chars}:{chars + size}")
        chars, at = chars + size, end
    return b"".join([*kept, text[at:]]), ",".join(listed)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document without the sentences that an earlier one, or its own text before, has in a run; see cut_repeats()."""
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
