"""Token functions of recall and of name matching, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """All [a-z0-9]+ of the lower-cased text, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """Drop one final s of a token longer than three."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, 1, F.length(token) - 1)).otherwise(token)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), stem))


def name_tokens(text: Column) -> Column:
    return F.array_distinct(words(text))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; zero for a query without tokens."""
    n = F.size(query)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / F.greatest(n, F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(longest, F.lit(1)))


def lexical_similarity(a: Column, b: Column, s: Column | None = None, t: Column | None = None) -> Column:
    """0.9 where one token set holds the other, else the larger of Jaccard and edit similarity; s and t are the token sets if known."""
    s, t = (name_tokens(a), name_tokens(b)) if s is None else (s, t)
    both, either = F.size(F.array_intersect(s, t)), F.size(F.array_union(s, t))
    inside = (F.size(s) > 0) & (F.size(t) > 0) & (both == F.least(F.size(s), F.size(t)))
    jaccard = F.when(either == 0, F.lit(0.0)).otherwise(both / F.greatest(either, F.lit(1)))
    return F.when(inside, F.lit(0.9)).otherwise(F.greatest(jaccard, edit_similarity(a, b)))


def display(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.replace(F.concat_ws(" ", subject, predicate, object_), F.lit("_"), F.lit(" "))


def edge_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, object_)


def session_date(label: Column, index: Column) -> Column:
    """The date after the first "on " of a label, as in "... on 1 January, 2023"; others are 30 days apart from 2022 on."""
    told = F.regexp_extract(F.coalesce(label, F.lit("")), "on (.+)", 1)
    day = lambda f: F.try_to_timestamp(F.trim(told), F.lit(f)).cast("date")
    return F.coalesce(F.when(told != "", F.coalesce(day("d MMMM, y"), day("d MMMM y"))), F.date_add(F.lit("2022-01-01").cast("date"), index * 30))


def iso(time: Column) -> Column:
    """An instant as ISO text with the offset of UTC; null stays null."""
    return F.date_format(F.to_utc_timestamp(time.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def checked_time(text: Column) -> Column:
    """An ISO date or time as an instant (UTC without a zone), or null if it is malformed."""
    return F.try_to_timestamp(text)


# Words that say nothing of a question's subject.
STOP = frozenset("a an and are as at be by did do does for from had has have he her his i in is it its me my of on or she that the their them they this to was were what when where which who whom why will with you your".split())


def keyword_rank(query: Column, text: Column) -> Column:
    """How densely the question's words stand in a text: ten times their share of its words, at most 1.

    A ranking by term frequency beside `overlap`, as databases have; 0 for a question without a telling word.
    """
    told = F.filter(token_set(query), lambda w: ~w.isin(*sorted(STOP)))
    own = F.transform(words(text), stem)
    hits = F.size(F.filter(own, lambda w: F.array_contains(told, w)))
    return F.when((F.size(told) == 0) | (F.size(own) == 0), F.lit(0.0)).otherwise(F.least(10.0 * hits / F.greatest(F.size(own), F.lit(1)), F.lit(1.0)))
