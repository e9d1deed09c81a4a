"""Quality rules, line first.

Each line of a document is held against punctuation, navigation and boilerplate rules. Lines
that fail are removed; a document that loses too much of its text, or fails the base rules, is
rejected. The cleaned text of kept documents is returned beside the counts.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .words import in_document, map_texts, span_hash, split, windows

# The rules' marks, phrases and thresholds.
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
SEPARATORS = "|"
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript", "subscribe to our newsletter", "click here", "sign up now", "share this page", "back to top")
#: A line of at most so many words is boilerplate if it holds one of PHRASES.
PHRASE_WORDS = 12
#: Percent of a line's characters other than spaces that may be SYMBOLS.
MOST_SYMBOLS = 10
#: Percent of a line's words that may be followed by a shout mark; shorter lines than so many words pass.
MOST_SHOUTS, SHOUT_WORDS = 50, 3
#: A line with so many separators, one for every so many words at least, is navigation.
NAV_MARKS, NAV_WORDS = 3, 4
#: Lines of so many words at most that end in none of STOPS are items of a menu where so many of them follow each other.
STOPS = ".!?:;,\")"
#: Closing marks of other scripts, of two or three bytes.
WIDE_STOPS = "»…’”›。、！？：；，．」』）】》〉؟؛،।॥։።"
ITEM_WORDS, ITEM_LINES = 3, 4
#: Characters of an item at most: a line of a script without spaces is one word and may be a whole sentence.
ITEM_CHARS = 40
#: Percent of a line's ASCII letters that may be capitals; lines with fewer letters pass.
MOST_CAPITALS, CAPITAL_LETTERS = 70, 20
#: Percent of the words that a document may lose with its lines.
MOST_LOST = 40
LEAST_WORDS = 50
MOST_REPEATED = 50


def _marks(chars: str) -> np.ndarray:
    of = np.zeros(256, bool)
    of[list(chars.encode())] = True
    return of


_SYMBOL, _SHOUT, _SEPARATOR = _marks(SYMBOLS), _marks(SHOUTS), _marks(SEPARATORS)
_WIDE = np.unique([int.from_bytes(c.encode(), "big") for c in WIDE_STOPS])
_SPACE = _marks(" \t\n\v\f\r")
_STOP, _CAPITAL, _LETTER = _marks(STOPS), _marks(string.ascii_uppercase), _marks(string.ascii_letters)


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def judge(data: np.ndarray, offsets: np.ndarray, texts: bool = True) -> dict:
    """Counts and verdicts of the documents data[offsets[i]:offsets[i + 1]]."""
    docs = len(offsets) - 1
    w = split(data, offsets)
    n_words = np.diff(w.first)
    char = (data & 0xC0) != 0x80
    ink = char & ~_SPACE[data]
    inks, symbols = _running(ink), _running(_SYMBOL[data])
    # Lines: they end at each \n and at each document's end.
    cuts = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([cuts, offsets[1:]]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(docs), np.searchsorted(offsets, cuts, "right") - 1]), kind="stable")
    words_to = np.searchsorted(w.start, end)
    words = words_to - np.searchsorted(w.start, start)
    full = np.flatnonzero(words > 0)
    key = in_document(span_hash(w.sums, start[full], end[full]), doc[full])
    _, firsts = np.unique(key, return_index=True)
    repeated = np.ones(len(full), bool)
    repeated[firsts] = False
    # np.unique gives a first occurrence, so later equal lines are the repeated ones.
    n_dup = np.bincount(doc[full][repeated], minlength=docs)
    at, h = windows(w, 3)
    of_word = w.doc
    _, back, times = np.unique(in_document(h, of_word[at]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(w.hash) + 2, bool)
    twice = at[times[back] >= 2]
    for j in range(3):
        covered[twice + j] = True
    n_repeat = np.bincount(of_word[covered[: len(w.hash)]], minlength=docs)

    # Rules on lines.
    line_ink = inks[end] - inks[start]
    shouts = _running(_SHOUT[data] & np.concatenate([_SPACE[data[1:]], [True]])) if len(data) else np.zeros(1, int)
    marks = _running(_SEPARATOR[data])
    n_shout, n_mark = shouts[end] - shouts[start], marks[end] - marks[start]
    bad = 100 * (symbols[end] - symbols[start]) > MOST_SYMBOLS * line_ink
    bad |= (words >= SHOUT_WORDS) & (100 * n_shout > MOST_SHOUTS * words)
    bad |= (n_mark >= NAV_MARKS) & (n_mark * NAV_WORDS >= words)
    capitals, letters = _running(_CAPITAL[data]), _running(_LETTER[data])
    n_letters = letters[end] - letters[start]
    bad |= (n_letters >= CAPITAL_LETTERS) & (100 * (capitals[end] - capitals[start]) > MOST_CAPITALS * n_letters)
    closed = np.zeros(len(words), bool)
    last = w.end[words_to[full] - 1]
    closed[full] = _STOP[data[last - 1]]
    for width in (2, 3):
        long = np.flatnonzero(last - w.start[words_to[full] - 1] >= width)
        code = sum(data[last[long] - 1 - k].astype(np.int64) << (8 * k) for k in range(width))
        closed[full[long]] |= np.isin(code, _WIDE)
    item = (words > 0) & (words <= ITEM_WORDS) & (line_ink <= ITEM_CHARS) & ~closed
    run = np.cumsum(np.concatenate([[False], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])) if len(item) else np.zeros(0, np.int64)
    bad |= item & (np.bincount(run)[run] >= ITEM_LINES if len(run) else item)
    low = bytes(data).lower()
    for phrase in PHRASES:
        found = low.find(phrase.encode())
        while found >= 0:
            line = np.searchsorted(start, found, "right") - 1
            bad[line] |= words[line] <= PHRASE_WORDS and found + len(phrase) <= end[line]
            found = low.find(phrase.encode(), found + 1)
    bad[full[repeated]] = True
    lost = np.bincount(doc[bad], words[bad], docs).astype(np.int64)

    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    kept = ~base_failed & (100 * lost <= MOST_LOST * n_words)
    out = {
        "n_words": n_words, "word_chars": inks[offsets[1:]] - inks[offsets[:-1]], "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": kept, "n_lost_words": lost,
    }
    if texts:
        lines = np.searchsorted(doc, np.arange(docs + 1))
        raw = bytes(data)
        out["clean_text"] = pa.array([b"\n".join([raw[start[i] : end[i]] for i in range(lines[d], lines[d + 1]) if not bad[i]]) if kept[d] else None for d in range(docs)], pa.binary()).cast(pa.string())
    return out


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: id, the counts, base_failed, kept, n_lost_words and (texts) clean_text.

    Null and empty texts have no words and fail the base rules. clean_text is null where kept is
    false. Rows are judged one by one: repeated rows get equal results, other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    out = map_texts(rows, "body", lambda data, offsets: judge(data, offsets, texts), ADDED + (", clean_text string" if texts else ""))
    return out.withColumnRenamed("id", id_col).drop("body") if id_col != "body" else out.drop("body").withColumnRenamed("id", id_col)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, base_failed, kept and n_lost_words of every row of documents; see quality for null and empty texts."""
    return quality(table(spark, sf_dir, "documents"), texts=False)


OP10_SQL = """
with d as (select row_number() over () rid, doc_id, coalesce(text, '') as text from documents),
tok as (select rid, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) as i from d),
win as (select rid, i, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from tok window o as (partition by rid order by i)),
cnt as (select rid, i, w2 is not null and count(*) over (partition by rid, w, w1, w2) >= 2 as twice from win),
cov as (select rid, twice or coalesce(lag(twice, 1) over o, false) or coalesce(lag(twice, 2) over o, false) as c from cnt window o as (partition by rid order by i)),
per as (select rid, count(*) as n_words, count(*) filter (where c) as n_repeat_words from cov group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
lw as (
  select *, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) as nw, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) as ink,
    length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) as sym, length(regexp_replace(l, '[^|]', '', 'g')) as bars,
    len(regexp_extract_all(l || ' ', '[!?][\\x20\\x09-\\x0D]')) as shouts, length(regexp_replace(l, '[^A-Z]', '', 'g')) as caps, length(regexp_replace(l, '[^A-Za-z]', '', 'g')) as letters,
    regexp_matches(l, '[.!?:;,")»…’”›。、！？：；，．」』）】》〉؟؛،।॥։።][\\x20\\x09-\\x0D]*$') as closed, row_number() over (partition by rid, l order by i) > 1 as again from lines),
it as (select *, nw between 1 and 3 and ink <= 40 and not closed as item from lw),
ru as (select *, i - row_number() over (partition by rid, item order by i) as run from it),
li as (select *, item and count(*) over (partition by rid, item, run) >= 4 as listed from ru),
judged as (
  select *, nw > 0 and again as dup,
    100 * sym > 10 * ink or (nw >= 3 and 100 * shouts > 50 * nw) or (bars >= 3 and bars * 4 >= nw) or (nw > 0 and again) or listed or (letters >= 20 and 100 * caps > 70 * letters)
    or (nw <= 12 and regexp_matches(lower(l), 'all rights reserved|privacy policy|terms of use|terms of service|cookie policy|accept cookies|enable javascript|subscribe to our newsletter|click here|sign up now|share this page|back to top')) as bad
  from li),
agg as (select rid, sum(ink) as word_chars, sum(sym) as n_symbols, count(*) filter (where dup) as n_dup_lines, coalesce(sum(nw) filter (where bad), 0) as n_lost_words from judged group by rid),
al as (
  select doc_id, coalesce(n_words, 0)::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint n_repeat_words, n_lost_words::bigint n_lost_words
  from d join agg using (rid) left join per using (rid))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_lost_words <= 40 * n_words as kept from al
"""
