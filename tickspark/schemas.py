"""Column contracts of the tables. Times are epoch milliseconds in UTC, prices doubles; ``seq`` is a tick's place in its feed."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "doubles": T.ArrayType(T.DoubleType()), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in spec.split())])


TICK = _struct("symbol:string seq:long time_ms:long bid:double ask:double flags:int")
CANDIDATE = _struct("candidate_id:string symbol:string direction:string entry:double stop_loss:double take_profit:double available_ms:long max_holding_ms:long risk_fraction:double pair:string timeframe:string level:double atr:double")
CALENDAR = _struct("snapshot_id:string as_of_ms:long source:string event_id:string event_code:string name:string currency:string scheduled_ms:long impact:string")
LEDGER = _struct("symbol:string chunk_start_ms:long chunk_end_ms:long tick_count:long status:string")
#: What an ingest enters for a chunk: the run that made the entry, the verdict on its ticks and where they come from.
LINEAGE = _struct("symbol:string chunk_start_ms:long chunk_end_ms:long tick_count:long status:string run:long hard_failures:strings duplicates:long source:string calendar_snapshot_id:string config_sha256:string lineage_id:string")
COST = _struct("session:string regime:string direction:string entry_slip:double exit_slip:double latency_ms:double commission_r:double stop_slip:double rollover_r:double event_slip:double")
TRADE = _struct("symbol:string ts_ms:long net_r:double mae_r:double mfe_r:double")
REGIME_OBSERVATION = _struct("symbol:string ts_ms:long rv_short:double rv_long:double spread_median:double spread_p95:double intensity:double abs_return:double missing_ratio:double")

HOUR = 3_600_000
DAY = 24 * HOUR
PIP = 0.0001
#: Bars with one of these flags start no candidate and no study.
UNUSABLE = ("HAS_SUSPICIOUS_GAP", "EXTREME_SPREAD", "INCOMPLETE_OR_EMPTY_INTERVAL")
