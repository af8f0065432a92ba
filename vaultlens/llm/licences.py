"""Licence scans by sentence rules.

A text is cut into units (at line ends, and after . ! ? ; : before white space), each unit is normalised (lower case, letters and
digits, single spaces), and numbers and letters of lists are left out. A known sentence is a row of at most UNITS units that together are its words: so
line wraps, comment marks and full stops inside a sentence (v. 2.0) don't hide it, and it starts and ends with units. At each
place the longest known sentence counts. The sequence of the sentences' identifiers, with 0 for
what stands between them, is matched against ordered rules: a rule holds where its identifiers stand in a row, and rules are
tried in order, so a longer rule takes its sentences before a shorter one sees them.

Everything happens inside a row with DataFrame expressions: nothing is shuffled
and no document meets another. Sentences are looked up in one map and rules are tried in one fold, so the plan doesn't grow with
the catalogue; only texts with one of the words that known sentences hold (TELLING, OR) are cut. Sentences and rules are arguments
(licence_texts holds the default ones).

Edge cases: null or empty texts hold no licence and give no rows; a licence that a
text states several times is one row with its first place and count; equal rows give
their own rows; an empty table gives no rows; texts are scanned whole; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common
from .licence_texts import FORM, OPENINGS, catalogue

_CATALOGUE = catalogue()
#: Known sentences by number, all wordings with their numbers, and rules.
SENTENCES, KNOWN, RULES = _CATALOGUE.sentences, _CATALOGUE.known, _CATALOGUE.rules
#: Every known sentence holds one of these, or matches OR, in lower case and whatever the line wraps.
TELLING, OR = ("licen", "copyright", "warrant", "redistribut", "domain", "rights", "permission", "software", "wtfpl", "gpl", "cc0", "copy", "eupl", "creative", "acknowledg", "mozilla"), "cc[^a-z0-9]+by"
UNITS = 40


def sentence_ids(df: DataFrame, known: dict[str, int] = KNOWN, units: int = UNITS, telling: tuple[str, ...] = TELLING) -> DataFrame:
    """df with column ids: (id, at) of each known sentence in order, at: its first unit; id 0 for what stands between two; only rows that have some."""
    words = "map_from_arrays(array({}), array({}))".format(", ".join(f"'{s}'" for s in known), ", ".join(map(str, known.values())))
    first = ", ".join(f"'{w}'" for w in sorted({s.split(" ")[0] for s in known} | set(OPENINGS)))
    df = common.held(df, "_l", "lower(coalesce(text, ''))")
    if telling:
        df = df.filter(" or ".join([*(f"contains(_l, '{w}')" for w in telling), f"_l rlike '{OR}'"]))
    # (a) and 1) in front of a line are left out
    lines = r"regexp_replace(regexp_replace(_l, '([.!?;:])[\\x20\\x09-\\x0D]+', '$1\n'), '(?m)^[^\\p{L}\\p{N}\n]*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})\\)[\\x20\\x09]', '')"
    cut = rf"split(trim(regexp_replace(regexp_replace({lines}, '[^\\p{{L}}\\p{{N}}\n]+', ' '), ' *\n[ \n]*', '\n')), '\n')"
    df = common.held(df, "_u", f"filter({cut}, s -> s <> '' and not s rlike '^([0-9]{{1,2}}|[a-z]|[ivx]{{1,4}})$')").filter("size(_u) > 0")
    starts = f"filter(sequence(0, size(_u) - 1), i -> array_contains(array({first}), substring_index(_u[i], ' ', 1)))"
    row = f"transform(sequence(1, least({units}, size(_u) - i)), k -> struct(try_element_at({words}, regexp_replace(array_join(slice(_u, i + 1, k), ' '), '{FORM}', 'under ')) as id, k as k))"
    df = common.held(df, "_r", f"filter(transform({starts}, i -> struct(i as at, try_element_at(filter({row}, r -> r.id is not null), -1) as r)), x -> x.r is not null)").filter("size(_r) > 0")
    fold = """aggregate(_r, struct(0 as next, cast(array() as array<struct<id: int, at: int>>) as seq), (s, x) -> if(x.at < s.next, s,
        struct(x.at + x.r.k as next, concat(s.seq, if(size(s.seq) > 0 and x.at > s.next, array(struct(0 as id, s.next as at)), array()), array(struct(x.r.id as id, x.at as at))) as seq))).seq"""
    return common.held(df, "ids", fold).drop("_l", "_u", "_r")


def matched(df: DataFrame, rules: list[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """df with column hits: (rule, licence, first_sentence, times) of each rule that holds.

    A rule's match is overwritten by marks of the same number of sentences, so that places stay.
    """
    table = ", ".join(f"struct({k} as rule, '{licence}' as licence, '{''.join(f'<{i}>' for i in ids)}' as row, '{'<x>' * len(ids)}' as marks)" for k, (licence, ids) in enumerate(rules))
    place = "ids[length(regexp_replace(substring_index(s.q, r.row, 1), '[^<]', ''))].at"
    hit = f"struct(r.rule as rule, r.licence as licence, {place} as first_sentence, cast((length(s.q) - length(replace(s.q, r.row, ''))) div length(r.row) as int) as times)"
    start = "struct(concat('', array_join(transform(ids, x -> concat('<', x.id, '>')), '')) as q, cast(array() as array<struct<rule: int, licence: string, first_sentence: int, times: int>>) as hits)"
    fold = f"aggregate(array({table}), {start}, (s, r) -> if(contains(s.q, r.row), struct(replace(s.q, r.row, r.marks) as q, concat(s.hits, array({hit})) as hits), s)).hits"
    return common.held(df, "hits", fold).filter("size(hits) > 0")


def licences(docs: DataFrame, known: dict[str, int] = KNOWN, rules: list[tuple[str, tuple[int, ...]]] = RULES) -> DataFrame:
    """doc_id, licence, first_sentence (from 0, among units with words), times, rules: one row for each document and licence."""
    telling = TELLING if known is KNOWN else ()
    found = matched(sentence_ids(docs.select("doc_id", "text"), known, telling=telling).select("doc_id", "ids"), rules)
    names = F.expr("array_distinct(transform(hits, h -> h.licence))")
    own = "filter(hits, h -> h.licence = licence)"
    rows = found.select("doc_id", "hits", F.explode(names).alias("licence"))
    return rows.selectExpr("doc_id", "licence", f"array_min(transform({own}, h -> h.first_sentence)) as first_sentence", f"aggregate({own}, 0, (a, h) -> a + h.times) as times", f"array_join(transform({own}, h -> h.rule), ' ') as rules")
