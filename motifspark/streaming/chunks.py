"""k-mismatch search over texts that come in chunks: rows (stream, seq, text, reset).

A stream's text is its chunks by seq; positions count from its start, or from the last chunk whose `reset` is
true. Matches may reach over any number of chunks. An empty or null chunk moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from motifspark.operators.search import BLOCK, Patterns, codes, kmismatch

#: Chunks of a stream that are counted together, and characters that are searched together at least.
SPAN, PIECE = 1024, 1 << 16


def placed(chunks: DataFrame) -> DataFrame:
    """(stream, text, era, base) of the chunks that have text: era counts the resets up to a chunk, base the
    characters before it since the last one. Sums run in spans of SPAN seqs and then over the spans'
    totals, so that no task gets all chunks of a stream."""
    rows = chunks.select("stream", F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("reset", F.lit(False)).alias("reset"))
    rows = rows.withColumn("span", F.expr(f"seq div {SPAN} - CAST(seq < 0 AS INT)"))
    own = Window.partitionBy("stream", "span").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("text").cast("long")
    rows = rows.withColumns({"behind": F.sum(size).over(own), "era": F.sum(F.col("reset").cast("long")).over(own)})
    rows = rows.withColumn("began", F.max(F.expr("CASE WHEN reset THEN behind - length(text) END")).over(own))
    totals = rows.groupBy("stream", "span").agg(F.max("behind").alias("size"), F.max("era").alias("eras"), F.max("began").alias("last"))
    before = Window.partitionBy("stream").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("sizes", F.coalesce(F.sum("size").over(before), F.lit(0)))
    totals = totals.withColumns({"earlier": F.coalesce(F.sum("eras").over(before), F.lit(0)), "start": F.coalesce(F.max(F.col("sizes") + F.col("last")).over(before), F.lit(0))})
    totals = totals.select(F.col("stream").alias("_s"), F.col("span").alias("_p"), "sizes", "earlier", "start")
    rows = rows.join(totals, F.expr("stream <=> _s AND span <=> _p"))
    start = F.expr("CASE WHEN began IS NULL THEN start ELSE sizes + began END")
    rows = rows.select("stream", "text", (F.col("era") + F.col("earlier")).alias("era"), (F.col("sizes") + F.col("behind") - F.length("text") - start).alias("base"))
    return rows.where("length(text) > 0")


def chunked_search(chunks: DataFrame, patterns: DataFrame, k: int, longest: int | None = None, circular: bool = False) -> DataFrame:
    """(stream, era, pattern_id, pos, distance[, rotation]) of a table of chunks; era counts the resets before.

    A stream's text is searched in pieces of equal length, each with the characters behind it that a match
    of the longest pattern may need; what a piece needs of each chunk is brought together, so each
    character is moved twice at most, however short the chunks. Seqs of a stream do not repeat. `longest`
    need not be given; patterns longer than it raise ValueError.
    """
    most = patterns.agg(F.coalesce(F.max(F.length("pattern")), F.lit(1))).first()[0]
    if longest is not None and most > longest:
        raise ValueError("a pattern is longer than `longest`")
    size, over = max(PIECE, most), max(most, 1) - 1
    rows = placed(chunks).withColumn("piece", F.explode(F.expr(f"sequence(greatest(0L, base - {over}) div {size}, (base + length(text) - 1) div {size})")))
    low, high = f"greatest(base, piece * {size})", f"least(base + length(text), piece * {size} + {size + over})"
    rows = rows.withColumn("part", F.expr(f"substring(text, CAST({low} - base AS INT) + 1, CAST({high} - {low} AS INT))"))
    parts = F.sort_array(F.collect_list(F.struct("base", "part"))).alias("parts")
    pieces = rows.groupBy("stream", "era", "piece").agg(parts).select(F.struct("stream", "era", "piece").alias("text_id"), F.array_join("parts.part", "").alias("text"))
    found = kmismatch(pieces, patterns, k, circular).where(f"pos < {size}")
    return found.select("text_id.stream", "text_id.era", "pattern_id", (F.col("text_id.piece") * size + F.col("pos")).alias("pos"), "distance", *(["rotation"] if circular else []))


EVENTS = "kind string, stream string, seq long, era long, pattern_id long, pos long, distance int, rotation int"
#: The state store that stateful processors need.
_STORE = "spark.sql.streaming.stateStore.providerClass", "RocksDBStateStoreProvider"


class ChunkProcessor(StatefulProcessor):
    """State of a stream: where it is (next seq, base, era, the last characters that a match may still begin
    in), at most `waiting` chunks that came before their turn, and the timer of the gap that they wait for."""

    def __init__(self, names, wanted, longest: int, waiting: int, gap_ms: int | None, idle_ms: int | None, timed: bool):
        self.names, self.wanted, self.longest, self.most = names, wanted, longest, waiting
        self.gap_ms, self.idle_ms, self.timed = gap_ms, idle_ms, timed

    def init(self, handle) -> None:
        self.handle = handle
        # Event time has no time to live; there a timer ends an idle stream.
        ttl = {} if self.timed or self.idle_ms is None else {"ttl_duration_ms": self.idle_ms}
        self.place = handle.getValueState("place", "turn long, base long, era long, tail string, seen long, timer long", **ttl)
        self.waiting = handle.getMapState("waiting", "seq long", "text string, reset boolean", **ttl)

    def _read(self, key, seq, text, reset, place, out) -> None:
        """One chunk in its turn."""
        import numpy as np

        turn, base, era, tail = place
        if reset:
            base, era, tail = 0, era + 1, ""
        joined = tail + text
        if text:
            for number, start, distance, rotation in self.wanted.search(codes(joined), np.array([len(joined)]), max(BLOCK, self.wanted.longest)):
                for n, at, d, r in zip(number.tolist(), start.tolist(), distance.tolist(), rotation.tolist()):
                    if at + int(self.wanted.sizes[n]) > len(tail):
                        out.append(("match", key, seq, era, self.names[n], base + at, d, r))
        kept = min(len(joined), self.longest - 1)
        place[:] = [seq + 1, base + len(joined) - kept, era, joined[len(joined) - kept :]]

    def _go_on(self, key, place, chunks, out, give_up: bool) -> None:
        """Reads the chunks whose turn it is; give_up leaves a gap behind, as more than `most` chunks do."""
        while chunks:
            if place[0] not in chunks:
                first = min(chunks)
                if not give_up and len(chunks) <= self.most:
                    return
                # What is lost has no length, so the text begins anew.
                out.append(("gap", key, place[0], place[2], None, first - place[0], None, None))
                place[:], give_up = [first, 0, place[2] + 1, ""], False
            text, reset = chunks.pop(place[0])
            self._read(key, place[0], text, reset, place, out)

    def _kept(self, key, place, seen, timer, before, chunks, now) -> None:
        """Writes the state; a timer runs as long as chunks wait, or until an idle stream ends."""
        for seq in before - chunks.keys():
            self.waiting.removeKey((seq,))
        for seq in chunks.keys() - before:
            self.waiting.updateValue((seq,), chunks[seq])
        wait = self.gap_ms if chunks else self.idle_ms if self.timed else None
        at = None if wait is None else now + wait
        # A gap's timer stays as it is while the gap does.
        if chunks and timer is not None and timer[1] == place[0]:
            at = timer[0]
        elif timer is not None and (at is None or timer[0] != at):
            self.handle.deleteTimer(timer[0])
        if at is not None and (timer is None or timer[0] != at):
            self.handle.registerTimer(at)
        self.place.update((*place, seen, -1 if at is None else at))

    def _state(self):
        turn, base, era, tail, seen, timer = self.place.get() if self.place.exists() else (0, 0, 0, "", 0, -1)
        chunks = {int(k[0]): (v[0], bool(v[1])) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        return [turn, base, era, tail], int(seen), None if timer is None or timer < 0 else (int(timer), turn), chunks

    def _frame(self, out):
        import pandas as pd

        frame = pd.DataFrame(out, columns=["kind", "stream", "seq", "era", "pattern_id", "pos", "distance", "rotation"])
        return frame.astype({"seq": "Int64", "era": "Int64", "pattern_id": "Int64", "pos": "Int64", "distance": "Int32", "rotation": "Int32"})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        place, seen, timer, chunks = self._state()
        before, out = set(chunks), []
        for frame in rows:
            times = frame["event_ms"].astype("int64") if self.timed else [0] * len(frame)
            for seq, text, reset, time in zip(frame["seq"], frame["text"], frame["reset"], times):
                seq, seen = int(seq), max(seen, int(time))
                if seq < place[0] or seq in chunks:
                    # Read already, or given up: repeated or late, and no part of the text any more.
                    out.append(("left", key[0], seq, place[2], None, None, None, None))
                    continue
                chunks[seq] = (text if isinstance(text, str) else "", bool(reset) if reset is not None and reset == reset else False)
                # Chunks are read as soon as they can be, so no more than `most` are held.
                self._go_on(key[0], place, chunks, out, False)
        self._kept(key, place, seen, timer, before, chunks, self._now(seen, timerValues))
        yield self._frame(out)

    def _now(self, seen, timers) -> int:
        return seen if self.timed else 0 if self.gap_ms is None else timers.getCurrentProcessingTimeInMs()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        place, seen, timer, chunks = self._state()
        out, before = [], set(chunks)
        if chunks:
            self._go_on(key[0], place, chunks, out, True)
            self._kept(key, place, seen, None, before, chunks, self._now(seen, timerValues))
        elif self.timed:
            self.place.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_events(chunks: DataFrame, patterns: list[tuple[int, str]], k: int, circular: bool = False, longest: int | None = None, waiting: int = 1000, gap_seconds: float | None = None, idle_seconds: float | None = None, time_col: str | None = None) -> DataFrame:
    """Events of a streaming DataFrame of chunks (stream, seq, text, reset), whose seqs begin at 0: rows (kind,
    stream, seq, era, pattern_id, pos, distance, rotation).

    "match": a match, which ends in chunk seq. "gap": chunks from seq on, `pos` of them, did not come and are
    given up, when more than `waiting` chunks wait for them or they have been waited for for gap_seconds;
    the text begins anew behind them, in another era, as at a reset. "left": a chunk that came again or after
    it was given up; it is no part of the text, so repeated delivery repeats no match. A stream's state
    is thus bounded by `waiting` chunks and the longest pattern. It ends, seqs included, once nothing has
    come for idle_seconds. With time_col, a timestamp with a watermark on it, both times are event times;
    else they are processing times, and such a query does not end by itself, whatever its trigger.

    Patterns are (id, text) and are broadcast; empty or null ones are ignored. They may be others when the query
    starts again from its checkpoint, and hold from the next chunk on; `longest`, as much of the text as is
    kept, must then be given from the beginning. A pattern longer than it raises ValueError. The session
    must have the RocksDB state store.
    """
    spark = chunks.sparkSession
    if not (spark.conf.get(_STORE[0], "") or "").endswith(_STORE[1]):
        raise ValueError(f"{_STORE[0]} must be the {_STORE[1]}")
    known = [(i, p) for i, p in patterns if p]
    most = max([1, *(len(p) for _, p in known)])
    if longest is not None and most > longest:
        raise ValueError("a pattern is longer than `longest`")
    if k < 0 or waiting < 0:
        raise ValueError("k and waiting must not be negative")
    wanted = Patterns([p for _, p in known], k, circular)
    millis = lambda s: None if s is None else round(1000 * s)
    processor = ChunkProcessor([i for i, _ in known], wanted, longest or most, waiting, millis(gap_seconds), millis(idle_seconds), time_col is not None)
    time = [] if time_col is None else [time_col, F.unix_millis(time_col).alias("event_ms")]
    rows = chunks.where("seq IS NOT NULL").select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), "text", "reset", *time)
    mode = "EventTime" if time_col is not None else "None" if gap_seconds is None and idle_seconds is None else "ProcessingTime"
    return rows.groupBy("stream").transformWithStateInPandas(processor, EVENTS, "Append", mode)


def stream_search(chunks: DataFrame, patterns: list[tuple[int, str]], k: int, **options) -> DataFrame:
    """(stream, pattern_id, pos, distance) of the matches of stream_events."""
    return stream_events(chunks, patterns, k, **options).where("kind = 'match'").select("stream", "pattern_id", "pos", "distance")
