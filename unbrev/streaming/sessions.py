"""Session features and pick outcomes on a stream.

Both keep their state per key in a state store (:func:`use_state_store`): single values
and a map of pages of words, so a batch reads and writes the pages that its own rows touch and
never a whole long session.  Rows of one key within a micro-batch are put into order first, so the
source's rate limit bounds what a task holds.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from unbrev.functions import scoring as sc
from unbrev.functions import text as tx
from unbrev.profile import Profile
from unbrev.settings import RECENCY_HALF_LIFE, TONE_HALF_LIFE

IDLE_MS = 24 * 3_600_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Have streams keep their state in RocksDB, which the processors here need.

    A session-level option; queries that run already keep the store they began with.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


# -- session features -----------------------------------------------------------------

_FEATURES = ["session", "pos", "norm", "tick", "recency", "tone_score", "tone_mass", "late"]


#: Words that a page of a session's vocabulary holds on average.
PAGE_WORDS = 128


def _page_of(norm: str, pages: int) -> int:
    """The page of a word among so many, which may grow one by one: a new page takes words of
    one other page only."""
    place, full = zlib.crc32(norm.encode()), 1 << (pages.bit_length() - 1)
    page = place % (2 * full)
    return page if page < pages else place % full


class _Vocabulary:
    """The last uses of a session's words, kept in pages of bounded size.

    A batch reads and writes the pages of its own words, each once, however many of its words
    are there.  ``at`` is the time of a word's last use, for those that age.
    """

    def __init__(self, stored, session: str, words: int, pages: int, now: int, keep_ms: int | None) -> None:
        self.stored, self.session, self.words, self.pages = stored, session, words, pages
        self.now, self.keep_ms = now, keep_ms
        self.read: dict[int, dict[str, list[int]]] = {}
        self.changed: set[int] = set()
        # Of a session that begins, or began anew, nothing is stored.
        self.begun = words > 0

    def _page(self, page: int) -> dict[str, list[int]]:
        if page not in self.read:
            found = self.stored.getValue((self.session, page)) if self.begun else None
            held = {} if found is None else json.loads(found[0])
            if self.keep_ms is not None:
                live = {w: use for w, use in held.items() if use[1] + self.keep_ms > self.now}
                self.words -= len(held) - len(live)
                held = live
            self.read[page] = held
        return self.read[page]

    def use(self, norm: str, tick: int) -> int | None:
        """Notes that a word is used; its last use before."""
        page = _page_of(norm, self.pages)
        words = self._page(page)
        before = words.get(norm)
        self.words += before is None
        words[norm] = [tick, self.now]
        self.changed.add(page)
        return None if before is None else before[0]

    def write(self) -> None:
        while self.words > PAGE_WORDS * self.pages:
            new = self.pages
            old = new - (1 << (new.bit_length() - 1))
            both, self.pages = self._page(old), new + 1
            self.read[new] = {w: use for w, use in both.items() if _page_of(w, self.pages) == new}
            self.read[old] = {w: use for w, use in both.items() if w not in self.read[new]}
            self.changed |= {old, new}
        for page in sorted(self.changed):
            self.stored.updateValue((self.session, page), (json.dumps(self.read[page], separators=(",", ":")),))


class _SessionTrack(StatefulProcessor):
    """Recency and tone of a group of sessions.

    ``clock`` holds for each session the number of words and of plain words so far, the
    decayed tone sums, the largest position, and the size of the vocabulary; ``seen`` holds the
    ticks of the last uses of its words, page by page.
    """

    def __init__(self, recency_half_life: float, tone_half_life: float, keep_ms: int | None) -> None:
        self.half_life = recency_half_life
        self.decay = 0.5 ** (1.0 / tone_half_life)
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        clock = "words BIGINT, tick BIGINT, score DOUBLE, mass DOUBLE, last BIGINT, known BIGINT, pages BIGINT"
        self.clock = handle.getMapState("clock", "session STRING", clock, self.keep_ms)
        self.seen = handle.getMapState("seen", "session STRING, page BIGINT", "words STRING", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["session", "pos"], kind="stable")
        now = 0 if self.keep_ms is None else timerValues.getCurrentProcessingTimeInMs()
        signed = batch["sign"].notna().tolist()
        columns = [batch[c].tolist() for c in ("session", "pos", "norm", "is_plain", "sign")]
        out = []
        for session, own in groupby(zip(*columns, signed), key=itemgetter(0)):
            out += self._features(session, own, now)
        yield pd.DataFrame(out, columns=_FEATURES)

    def _features(self, session: str, rows: Iterable[tuple], now: int) -> Iterator[tuple]:
        held = self.clock.getValue((session,))
        words, tick, score, mass, last, known, pages = held or (0, 0, 0.0, 0.0, None, 0, 1)
        vocabulary = _Vocabulary(self.seen, session, known, pages, now, self.keep_ms)
        for _, pos, norm, plain, sign, signed in rows:
            words += 1
            score, mass = score * self.decay, mass * self.decay
            if signed:
                score, mass = score + sign, mass + 1.0
            prior = 0.0
            if plain:
                before = vocabulary.use(norm, tick + 1)
                if before is not None:
                    prior = 0.5 ** ((tick - before) / self.half_life)
                tick += 1
            late = last is not None and pos < last
            last = pos if last is None else max(last, pos)
            yield session, words, norm, tick, prior, score, mass, late
        vocabulary.write()
        clock = (words, tick, score, mass, int(last), vocabulary.words, vocabulary.pages)
        self.clock.updateValue((session,), clock)


#: Groups that sessions are dealt to by hash.
SESSION_GROUPS = 4096


def stream_session_features(
    words: DataFrame,
    markers: DataFrame,
    profile: Profile,
    recency_half_life: float = RECENCY_HALF_LIFE,
    tone_half_life: float = TONE_HALF_LIFE,
    keep_ms: int | None = IDLE_MS,
    groups: int = SESSION_GROUPS,
) -> DataFrame:
    """Features of a streamed ``(session_id, pos, word)``, as the batch job gives them.

    Time is the number of words.  Within a micro-batch a session's words are taken by
    ``pos``; batches are taken as they come.  A word that comes in a later batch than
    words of a larger ``pos`` is ``late``: it is numbered where it arrives, as a word
    typed now, and changes nothing that was given out.  A change of context is a change
    of ``session_id``.

    What a session has not touched for ``keep_ms`` of processing time leaves the state
    word by word: a forgotten word counts as new, and a session whose last word is that
    old begins anew.  With None nothing is ever forgotten.  Ages keep a query running, so
    a query that is to end with its input (``availableNow``) needs None, or the option
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.

    Sessions are handed to Python in so many ``groups``, since each hand-over costs more than
    the words of a short session; many groups for each partition keep these even.  A
    checkpoint goes on with the number it began with only.
    """
    norm = tx.normalize(tx.strip(F.col("word")), profile)
    marks = markers.select(F.col("word").alias("mark"), F.col("sign").cast("double").alias("sign"))
    keyed = (
        words.select("session_id", F.col("pos").cast("bigint").alias("pos"), "word", norm.alias("norm"))
        .withColumn("is_plain", (F.col("norm") != "") & tx.is_plain_word(F.col("norm"), profile))
        .withColumn("mark", tx.normalize(F.col("word"), profile))
        .join(marks, "mark", "left")
        # Sessions as texts that are never null.
        .withColumn("session", F.coalesce(F.concat(F.lit("="), F.col("session_id").cast("string")), F.lit("")))
        .withColumn("group", F.pmod(F.xxhash64("session"), F.lit(groups)).cast("int"))
        .select("group", "session", "pos", "norm", "is_plain", "sign")
    )
    session_id = F.when(F.col("session") != "", F.substring("session", 2, 2**31 - 1))
    return (
        keyed.groupBy("group")
        .transformWithStateInPandas(
            _SessionTrack(recency_half_life, tone_half_life, keep_ms),
            "session STRING, pos BIGINT, norm STRING, tick BIGINT, recency DOUBLE, "
            "tone_score DOUBLE, tone_mass DOUBLE, late BOOLEAN",
            "append",
            "None" if keep_ms is None else "ProcessingTime",
        )
        .withColumn("register", sc.register(F.col("tone_score"), F.col("tone_mass")))
        .select(
            session_id.cast(words.schema["session_id"].dataType).alias("session_id"),
            *_FEATURES[1:],
            "register",
        )
    )


# -- pick outcomes --------------------------------------------------------------------

_OUTCOME = ["event_id", "user_id", "status", "resolved_ms"]


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class _PendingPick(StatefulProcessor):
    """The pick of one user that waits for its outcome, with a timer for when none comes."""

    def __init__(self, confirm_ms: int) -> None:
        self.confirm_ms = confirm_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "event_id BIGINT, ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get() if self.pending.exists() else None
        before = held
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, ts, kind in zip(events["event_id"], events["ts"], events["kind"]):
            now = _millis(ts)
            if held is not None and now < held[1]:
                # Older than the pick that waits: it cannot be what came after it.
                if kind == "pick":
                    out.append((int(event_id), key[0], "confirmed", held[1]))
                continue
            if held is not None:
                undone = kind == "undo" and now <= held[1] + self.confirm_ms
                end = min(now, held[1] + self.confirm_ms)
                out.append((held[0], key[0], "reverted" if undone else "confirmed", end))
            held = (int(event_id), now) if kind == "pick" else None
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before[1] + self.confirm_ms)
            if held is None:
                self.pending.clear()
            else:
                self.pending.update(held)
                self.handle.registerTimer(held[1] + self.confirm_ms)
        yield pd.DataFrame(out, columns=_OUTCOME)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at = self.pending.get(), expiredTimerInfo.getExpiryTimeInMs()
        self.pending.clear()
        yield pd.DataFrame([(held[0], key[0], "confirmed", at)], columns=_OUTCOME)


def stream_resolve_picks(
    events: DataFrame, confirm_ms: int = IDLE_MS, delay: str = "0 seconds"
) -> DataFrame:
    """Outcomes ``(event_id, user_id, status, resolved_ms)`` of streamed
    ``(event_id, ts, user_id, kind)``.

    A user's next event decides about a pick: an undo within ``confirm_ms`` of it reverts
    it, anything else confirms it.  If nothing comes, a timer in event time confirms it
    when the watermark, ``delay`` behind the newest event of all users, is past
    ``confirm_ms`` after the pick; no later undo changes that.  Results are the same
    whatever the batches, as long as each user's events come in order of time.

    Late rows: those behind the watermark are dropped.  Of those that are older than the
    pick that waits, an undo is ignored, since what it undid has been decided, and a pick
    is confirmed, since a newer one followed.
    """
    rows = events.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "kind")
    return (
        rows.withWatermark("ts", delay)
        .groupBy("user_id")
        .transformWithStateInPandas(
            _PendingPick(confirm_ms),
            "event_id BIGINT, user_id STRING, status STRING, resolved_ms BIGINT",
            "append",
            "EventTime",
        )
    )
