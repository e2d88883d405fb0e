"""Counters of builds, collected by the job that does the work.

``DataFrame.observe`` sums them up in the tasks as rows pass by; no row is read for
counting only.  In a batch job they are there when its table is written, in a stream
they come with the progress of every trigger.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from unbrev.functions import text as tx
from unbrev.operators.lexicons import vocabulary
from unbrev.plans import corpus, lexicon
from unbrev.profile import Profile
from unbrev.session import settle


@dataclass(frozen=True)
class Counted:
    """A table still to be made, and what will be counted while it is."""

    rows: DataFrame
    watches: tuple[Observation, ...]

    def watch(self, **counters: Column) -> Counted:
        """Count more, on the table as it is now."""
        seen = Observation()
        columns = [c.alias(name) for name, c in counters.items()]
        return Counted(self.rows.observe(seen, *columns), (*self.watches, seen))

    def then(self, step) -> Counted:
        """Go on with ``step(rows)``."""
        return Counted(step(self.rows), self.watches)

    def finish(self) -> tuple[DataFrame, dict[str, int]]:
        """Write the table once; the table and its counters (a sum of no rows is 0)."""
        made = settle(self.rows)
        return made, {k: v or 0 for seen in self.watches for k, v in seen.get.items()}


def counted(rows: DataFrame) -> Counted:
    return Counted(rows, ())


def count_if(good: Column) -> Column:
    """Rows for which a condition holds; null is no."""
    return F.count_if(F.coalesce(good, F.lit(False)))


def all_rows() -> Column:
    return F.count(F.lit(1))


def counted_lexicon(raw: DataFrame, profile: Profile, min_freq: float = 0.0) -> Counted:
    """:func:`lexicon.build_lexicon` with ``rows`` read, ``skipped`` because they are too
    rare or no words, and ``entries`` made."""
    usable = (F.col("freq") >= min_freq) & tx.is_lexicon_word(F.col("form"), profile)
    return (
        counted(raw)
        .watch(rows=all_rows(), skipped=F.count_if(~F.coalesce(usable, F.lit(False))))
        .then(lambda rows: lexicon.build_lexicon(rows, profile, min_freq))
        .watch(entries=all_rows())
    )


def counted_ngrams(
    lines: DataFrame, known: DataFrame, profile: Profile, min_count: int = 3
) -> tuple[Counted, Counted]:
    """The tables of :func:`corpus.build_bigrams`.

    Unigrams come with the ``lines`` and ``tokens`` read, and the ``types`` found with
    their uses ``known_tokens``; pairs with their number ``kept`` and uses ``kept_pairs``.
    """
    vocab = vocabulary(known, profile)
    tokens = counted(corpus.line_tokens(lines, profile)).watch(
        lines=all_rows(), tokens=F.sum(F.size("tokens").cast("bigint"))
    )
    unigrams = tokens.then(lambda rows: corpus.unigram_counts(rows, vocab))
    pairs = corpus.bigram_counts(corpus.line_tokens(lines, profile), vocab, min_count)
    return (
        unigrams.watch(types=all_rows(), known_tokens=F.sum("cnt")),
        counted(pairs).watch(kept=all_rows(), kept_pairs=F.sum("cnt")),
    )


def counted_calibration(
    known: DataFrame, dictionary: DataFrame, profile: Profile, max_len: int = lexicon.CALIBRATE_MAX_LEN
) -> Counted:
    """:func:`lexicon.calibrate_frequencies` with ``entries`` and those ``raised``."""
    done = lexicon.calibrate_frequencies(known, dictionary, profile, max_len)
    return counted(done).watch(entries=all_rows(), raised=count_if(F.col("raised")))


def counted_forms(known: DataFrame, paradigms: DataFrame, profile: Profile) -> Counted:
    """:func:`lexicon.expand_paradigm_forms` with the forms ``added``."""
    return counted(lexicon.expand_paradigm_forms(known, paradigms, profile)).watch(added=all_rows())


class ProgressCounters(StreamingQueryListener):
    """Sums of what streams observe, by name of the observation, over all triggers.

    Add it to ``spark.streams`` before the stream starts.  A trigger that runs again
    after a failure reports once, when it ends.
    """

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.ended = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            for counter, value in row.asDict().items():
                self.totals[name][counter] += value or 0

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
