"""Sessions, local clocks and the weekend, from epoch milliseconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DAY, HOUR

#: Session names and the UTC hour at which each ends.
SESSIONS = (("ASIA", 7), ("LONDON", 13), ("NY", 21), ("ROLLOVER", 24))
#: Benchmark -> zone and local hour.
BENCHMARKS = {"LONDON_OPEN": ("Europe/London", 8), "LONDON_FIX": ("Europe/London", 16), "NEW_YORK_CUT": ("America/New_York", 10)}


def day_number(ms: Column) -> Column:
    return F.floor(ms / DAY).cast("long")


def weekday(ms: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(day_number(ms) + 3, F.lit(7))


def utc_hour(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY)) / HOUR).cast("int")


def session(ms: Column) -> Column:
    hour = utc_hour(ms)
    out = F.lit(SESSIONS[-1][0])
    for name, end in reversed(SESSIONS[:-1]):
        out = F.when(hour < end, name).otherwise(out)
    return out


def inside_weekend(start: Column, end: Column) -> Column:
    """The whole half-open interval lies in one Saturday and Sunday."""
    day = weekday(start)
    return (day >= 5) & (end <= (day_number(start) + 7 - day) * DAY)


def touches_weekend(start: Column, end: Column) -> Column:
    """The half-open interval overlaps a Saturday or Sunday; an empty one overlaps nothing unless its day has begun before its end."""
    day = weekday(start)
    return ((day >= 5) & (day_number(start) * DAY < end)) | (end > (day_number(start) + 5 - day) * DAY) & (day < 5)


def local_time(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def utc_offset_hours(ms: Column, zone: str) -> Column:
    return ((F.unix_millis(local_time(ms, zone)) - ms) / HOUR).cast("int")


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def dst_state(ms: Column) -> Column:
    """Which of the two sides has its summer time on."""
    europe = utc_offset_hours(ms, "Europe/London") != 0
    america = utc_offset_hours(ms, "America/New_York") != -5
    return F.when(europe == america, "EU_US_ALIGNED").when(america, "US_DST_EU_STANDARD").otherwise("EU_DST_US_STANDARD")


def benchmark_minutes(ms: Column, name: str) -> Column:
    """Signed minutes, with seconds as a fraction, from the benchmark's local time on that local day."""
    zone, hour = BENCHMARKS[name]
    local = local_time(ms, zone)
    return (minute_of_day(local) - hour * 60).cast("double") + F.second(local) / 60.0


def session_open(ms: Column) -> Column:
    """Eight o'clock to the minute in London or, failing that, in New York."""
    at_eight = lambda zone: minute_of_day(local_time(ms, zone)) == 480
    return F.when(at_eight("Europe/London"), "LONDON_OPEN").when(at_eight("America/New_York"), "NEW_YORK_OPEN")


def period(ms: Column, discovery_end: int, confirmation_end: int) -> Column:
    return F.when(ms < discovery_end, "DISCOVERY").when(ms < confirmation_end, "CONFIRMATION").otherwise("LOCKED_HOLDOUT")


def calendar_days(start: Column, end: Column) -> Column:
    """Calendar days that a half-open range touches."""
    return day_number(end - 1) - day_number(start) + 1
