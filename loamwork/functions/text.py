"""Text analysis for full-text search: terms, the all-terms match and a document-local rank.

An analyzer is a term pattern and a stop list.  The rank is the sum of 1 + ln(tf) over the query's terms, so it
depends on the document alone and no other checkout's content can change it.  Scores aren't those of another
search engine, only the match, limits and order are comparable.
"""

from __future__ import annotations

import regex
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem, stem_word


@dataclass(frozen=True)
class Analyzer:
    """pattern: of a term in lower-cased text, for both the JVM's and Python's regular expressions; stems: English ones for
    words, after the stop list."""

    pattern: str = "[a-z0-9]+"
    stop: frozenset[str] = field(default_factory=frozenset)
    stems: bool = False

    def all_terms(self, text: Column) -> Column:
        """With repeats, for term counts; stop words are left in, as no query asks for them."""
        found = self._words(text)
        return F.transform(found, stem) if self.stems else found

    def counted_terms(self, text: Column) -> Column:
        """With repeats and without stop words, for an index."""
        found = self._words(text)
        if self.stop:
            found = F.filter(found, lambda x: ~F.array_contains(self._stopped(), x))
        return F.transform(found, stem) if self.stems else found

    def _words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(self.pattern), F.lit(0))

    def _stopped(self) -> Column:
        return F.array(*[F.lit(x) for x in sorted(self.stop)])

    def query_terms(self, query: str) -> list[str]:
        found = regex.findall(self.pattern, query.lower())
        return sorted({stem_word(x) if self.stems else x for x in found if x not in self.stop})


PLAIN = Analyzer()
#: Letters and digits of any script, for use outside of comparisons with plain SQL.
UNICODE = Analyzer(pattern="[\\p{L}\\p{N}_]+")
# Common English function words.
ENGLISH_STOP = frozenset("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with".split())
ENGLISH = Analyzer(stop=ENGLISH_STOP)
#: Words of any inflection meet at their stem.
STEMMED = Analyzer(stop=ENGLISH_STOP, stems=True)


def matches_all(terms: Column, query: list[str]) -> Column:
    """Whether all query terms are among the terms; a query without terms matches nothing."""
    if not query:
        return F.lit(False)
    return F.size(F.array_except(F.array(*[F.lit(x) for x in query]), terms)) == 0


def log_tf(terms: Column, query: list[str]) -> Column:
    """Sum of 1 + ln(tf) over the query's terms, rounded so that summation order can't reorder results."""
    tf = lambda q: F.size(F.filter(terms, lambda x: x == F.lit(q))).cast("double")
    parts = [F.lit(1.0) + F.log(tf(q)) for q in query]
    return F.round(sum(parts[1:], parts[0]), 6) if parts else F.lit(0.0)


def lines_of(text: Column) -> Column:
    """Lines as an editor counts them: a line feed ends a line, a carriage return before it is dropped."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "\\n\\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, "\\r(?=\\n|\\z)", ""), "\n"))
