"""The tables that operators work on.

samples: one row per value of a signal, keyed by KEY and ordered by ts_us, then seq, the value's place in its log.
"""

from pyspark.sql import Window, WindowSpec
from pyspark.sql import types as T

KEY = ["log_id", "topic", "multi_id", "field"]
ORDER = ["ts_us", "seq"]

SAMPLES = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("multi_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("v_str", T.StringType())])
TOPICS = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("multi_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("type_str", T.StringType()), T.StructField("sample_count", T.LongType())])
PARAMETERS = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("kind", T.StringType())])
INTERVALS = T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])

#: Operands of a check; every check type uses some of them.
CHECKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("check_id", "type", "window", "signal", "parameter", "first", "second", "actual", "setpoint", "metric", "op", "mode", "direction", "value_text", "source_predicate", "expression", "expected_expression", "supports", "contradicts", "role", "branch_id", "category")]
    + [T.StructField(n, T.DoubleType()) for n in ("value", "lower", "upper", "from_value", "to_value", "max_error", "min_error", "min_delta")]
    + [T.StructField(n, T.StringType()) for n in ("value_param", "lower_param", "upper_param")]  # operands given by a parameter's name
    + [T.StructField("variables", T.MapType(T.StringType(), T.StringType()))]  # signal, parameter or literal of each name of an expression
)


def in_time(*keys: str) -> WindowSpec:
    """The samples of a key in time order."""
    return Window.partitionBy(*(keys or KEY)).orderBy(*ORDER)
