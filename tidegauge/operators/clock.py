"""Trading time: the events of a session, and when a strategy is called."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidegauge.errors import DataError, RequestError

#: Minutes of a bar of each frequency; a daily bar is a session's.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "1d": None}
#: Events of one instant, in the order in which they are handled.
KINDS = ("session_start", "auction", "bar", "strategy", "session_end")
RANK = {"session_start": 0, "auction": 1, "bar": 1, "strategy": 2, "session_end": 3}


def clock(text: str) -> time:
    return time.fromisoformat(text)


@dataclass(frozen=True)
class Hours:
    """When a session starts and ends, its stretches of trading, when the daily bar is out, and the auction before (none: no
    event of its own)."""

    start: str = "09:25"
    end: str = "16:05"
    segments: tuple[tuple[str, str], ...] = (("09:30", "11:30"), ("13:00", "15:00"))
    daily_at: str = "16:05"
    auction: tuple[str, str] | None = ("09:15", "09:30")

    def __post_init__(self):
        if not self.segments:
            raise RequestError("hours have a stretch of trading")
        marks = [self.start, *(x for s in self.segments for x in s), self.daily_at, self.end]
        inside = all(a < b for a, b in self.segments)
        opening = self.auction is None or (self.auction[0] < self.auction[1] <= self.segments[0][0] and self.auction[1] >= self.start)
        if not inside or marks != sorted(marks) or not opening:
            raise RequestError("hours are in order: start, stretches of trading, daily bar, end; the auction ends between start and trading")


@dataclass(frozen=True)
class Event:
    """An instant of a run. start is where the bar that it completes begins, or the instant itself."""

    session: date
    at: datetime
    start: datetime
    kind: str


@dataclass(frozen=True)
class Schedule:
    """When a strategy is called: every bar, day, week, month or some minutes (`7m`); `at` moves calls by the day to a clock;
    times are the calls themselves."""

    every: str = "bar"
    at: str | None = None
    times: tuple[datetime, ...] | None = None

    def __post_init__(self):
        minutes = self.every[:-1]
        some = self.every.endswith("m") and minutes.isdigit() and int(minutes) > 0
        if self.every not in ("bar", "day", "week", "month") and not some:
            raise RequestError("every is bar, day, week, month or minutes such as 7m")
        if (self.at is not None and self.every not in ("day", "week", "month")) or (self.times is not None and (self.every != "bar" or self.at is not None)):
            raise RequestError("at belongs to day, week and month; times stand alone")


def _at(session: date, text: str | time) -> datetime:
    return datetime.combine(session, clock(text) if isinstance(text, str) else text)


def market_events(session: date, frequency: str, hours: Hours) -> list[Event]:
    """What happens in a session, whatever a strategy does."""
    if frequency not in MINUTES:
        raise RequestError(f"no frequency {frequency!r}")
    start, end = _at(session, hours.start), _at(session, hours.end)
    out = [Event(session, start, start, "session_start")]
    if frequency == "1d":
        out.append(Event(session, _at(session, hours.daily_at), _at(session, hours.segments[0][0]), "bar"))
    else:
        if hours.auction is not None:
            out.append(Event(session, _at(session, hours.auction[1]), _at(session, hours.auction[0]), "auction"))
        step = timedelta(minutes=MINUTES[frequency])
        for a, b in hours.segments:
            first, n = _at(session, a), (_at(session, b) - _at(session, a)) / step
            if n != int(n):
                raise RequestError(f"{frequency} does not divide the hours")
            out += [Event(session, first + (k + 1) * step, first + k * step, "bar") for k in range(int(n))]
    return [*out, Event(session, end, end, "session_end")]


def _calls(events: list[Event], schedule: Schedule, hours: Hours) -> list[datetime]:
    """The instants at which a schedule calls in a session whose day it has chosen."""
    session, bars = events[0].session, [e.at for e in events if e.kind == "bar"]
    if schedule.every == "bar":
        return bars
    if schedule.every in ("day", "week", "month"):
        return [_at(session, schedule.at) if schedule.at else bars[-1]]
    step, out = timedelta(minutes=int(schedule.every[:-1])), []
    for a, b in hours.segments:
        now = _at(session, a) + step
        while now <= _at(session, b):
            out.append(now)
            now += step
    return out


def chosen_sessions(sessions: list[date], calendar: list[date], every: str) -> set[date]:
    """Sessions on which a schedule calls: all, or the last of each ISO week or month, which only the session after it tells."""
    if every not in ("week", "month"):
        return set(sessions)
    following = dict(zip(calendar, calendar[1:], strict=False))
    lost = [s for s in sessions if s not in following]
    if lost:
        raise DataError(f"the calendar does not say what follows {lost[0]}")
    period = (lambda d: d.isocalendar()[:2]) if every == "week" else (lambda d: (d.year, d.month))
    return {s for s in sessions if period(s) != period(following[s])}


def session_events(session: date, frequency: str, hours: Hours, schedule: Schedule, chosen: bool) -> list[Event]:
    """A session's events in order, strategy calls included. A call is at an event, or where a bar begins; a DataError if not."""
    events = market_events(session, frequency, hours)
    if schedule.times is not None:
        calls = [t for t in schedule.times if t.date() == session]
    else:
        calls = _calls(events, schedule, hours) if chosen else []
    places: dict[datetime, datetime] = {e.at: e.start for e in events if e.kind == "bar"}
    for e in events:
        places.setdefault(e.at, e.start)
        if e.kind == "bar":
            places.setdefault(e.start, e.start)
    lost = sorted(set(calls) - set(places))
    if lost:
        raise DataError(f"a call at {lost[0]} is neither at an event nor where a bar begins")
    calls_ = [Event(session, t, places[t], "strategy") for t in sorted(set(calls))]
    return sorted([*events, *calls_], key=lambda e: (e.at, RANK[e.kind]))


def timeline(sessions: list[date], frequency: str = "1d", hours: Hours | None = None, schedule: Schedule | None = None, calendar: list[date] | None = None) -> list[Event]:
    """All events of sessions in order. calendar: the open days known, for weeks and months."""
    hours, schedule = hours or Hours(), schedule or Schedule()
    days = sorted(set(sessions))
    strange = [t for t in schedule.times or () if t.date() not in set(days)]
    if strange:
        raise DataError(f"a call at {strange[0]} is on no session")
    chosen = chosen_sessions(days, sorted(set(calendar or days)), schedule.every)
    return [e for s in days for e in session_events(s, frequency, hours, schedule, s in chosen)]


def timeline_df(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """timeline() as a table (session, at, start, kind, seq)."""
    rows = [(e.session, e.at, e.start, e.kind, k) for k, e in enumerate(timeline(*args, **kwargs))]
    return spark.createDataFrame(rows, "session date, at timestamp_ntz, start timestamp_ntz, kind string, seq int")
