"""Column functions: cleaning, banding, ratios, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VEHICLE_TYPES = ["SMALL", "MEDIUM", "LARGE"]
PEAK_FLAGS = ["PEAK_HOUR", "NORMAL", "OFF_PEAK"]
ONLINE_FLAGS = ["ONLINE", "OFFLINE", "UNKNOWN"]
DEVICE_TYPES = ["CAMERA", "SENSOR", "RADAR", "GATE"]
ALARM_TYPES = ["OFFLINE", "CPU_HIGH", "MEMORY_HIGH", "TEMP_HIGH", "SIGNAL_WEAK", "HARDWARE_FAULT"]
ALARM_LEVELS = ["CRITICAL", "MAJOR", "MINOR", "WARNING"]
#: Grades by least score, share of faults, jam and reliability.
HEALTH_GRADES = [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR"), (40, "POOR")]
FAULT_GRADES = [(50, "CRITICAL"), (20, "POOR"), (10, "WARNING")]
RELIABILITY = [(720, "HIGH"), (144, "MEDIUM")]
JAM_SPEEDS = [(60, 1), (40, 2), (25, 3), (15, 4)]
#: Least speed and greatest congestion rate of jam levels 1 to 4.
JAM_BANDS = [(1, 40, 15), (2, 30, 30), (3, 20, 50), (4, 10, 75)]
JAM_LABELS = {1: "FREE", 2: "FAIR", 3: "LIGHT", 4: "MEDIUM", 5: "SEVERE"}


def to_time(col: Column) -> Column:
    """A time, from a timestamp, its text, or epoch milliseconds of twelve digits or more; null where it is none of them."""
    text = col.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{12,}$"), F.timestamp_millis(text.try_cast("long"))), text.try_cast("timestamp"))


def normalize_enum(col: Column, domain: list[str], default: str) -> Column:
    return F.when(col.isin(domain), col).otherwise(F.lit(default))


def band(col: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """Label of the first step that the value reaches; a null value gets the default."""
    out = F.lit(default)
    for least, label in reversed(steps):
        out = F.when(col >= least, F.lit(label)).otherwise(out)
    return out


def decode(col: Column, labels: dict[int, str], default: str) -> Column:
    out = F.lit(default)
    for key, label in labels.items():
        out = F.when(col == key, F.lit(label)).otherwise(out)
    return out


def jam_from_speed(speed: Column) -> Column:
    """1 (over 60) to 5 (15 or less); null speeds are level 5."""
    out = F.lit(5)
    for over, level in reversed(JAM_SPEEDS):
        out = F.when(speed > over, F.lit(level)).otherwise(out)
    return out


def jam_from_bands(speed: Column, rate: Column, bands: list[tuple[int, float, float]] = JAM_BANDS) -> Column:
    """The least level whose least speed and greatest congestion rate both hold, else 5."""
    out = F.lit(5)
    for level, least_speed, most_rate in reversed(bands):
        out = F.when((speed >= least_speed) & (rate <= most_rate), F.lit(level)).otherwise(out)
    return out


def period(hour: Column) -> Column:
    return (F.when(hour.between(7, 9), "MORNING_PEAK").when(hour.between(17, 19), "EVENING_PEAK")
            .when(hour.between(6, 22), "DAY_NORMAL").otherwise("NIGHT_NORMAL"))


def health_flag(cpu: Column, memory: Column, temperature: Column, online: Column, signal: Column) -> Column:
    bad = (cpu > 90) | (memory > 90) | (temperature > 70) | (online == "OFFLINE") | (signal < -90)
    return F.when(bad, "ABNORMAL").when((cpu > 70) | (memory > 70) | (temperature > 50), "WARNING").otherwise("NORMAL")


def rounded(col: Column, places: int = 2) -> Column:
    """Rounds half up as double, nudged so that decimal and double means agree."""
    return F.round(col.cast("double") + F.lit(1e-9), places)


def mean(col: Column) -> Column:
    """Mean by an exact sum, as double; null without values."""
    return F.sum(col).cast("double") / F.nullif(F.count(col), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as double; null where whole is 0."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
