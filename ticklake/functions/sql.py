"""The scalars as SQL functions. Catalyst inlines their bodies, so they cost nothing extra."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ticklake.functions.scalars import _NUMBER, _PLAIN_NUMBER, MAX_DECIMAL

DEFINITIONS = {
    "tick_truncate": """(d DECIMAL(38,14)) RETURNS DECIMAL(18,8) RETURN
        CASE WHEN d > 9999999999.99999999BD THEN CAST('9999999999.99999999' AS DECIMAL(18,8))
             WHEN d < -9999999999.99999999BD THEN CAST('-9999999999.99999999' AS DECIMAL(18,8))
             ELSE try_cast(if(d >= 0, floor(d, 8), ceil(d, 8)) AS DECIMAL(18,8)) END""",
    "tick_interval_label": """(s INT) RETURNS STRING RETURN
        if(s >= 60 AND s % 60 = 0, concat(s div 60, 'm'), concat(s, 's'))""",
    "tick_shard": r"""(t STRING, n INT) RETURNS INT RETURN
        CAST((aggregate(flatten(transform(transform(regexp_extract_all(t, '(?s).', 0), c -> CAST(ascii(c) AS BIGINT)),
                                c -> if(c > 65535, array(55296L + shiftright(c - 65536L, 10), 56320L + ((c - 65536L) & 1023L)),
                                        array(c)))),
                        17L, (a, c) -> (a * 31 + c) & 4294967295L) & 2147483647L) % n AS INT)""",
    # The patterns are those of the Column form, so that both read the same texts the same way.
    "tick_parse_decimal": f"""(x STRING) RETURNS DECIMAL(38,8) RETURN coalesce(
        CASE WHEN x rlike r'{_PLAIN_NUMBER}' THEN try_cast(x AS DECIMAL(38,8))
             WHEN abs(try_cast(replace(substring(regexp_replace(x, r'{_NUMBER}', '=$1$4$2.$3'), 2), ',', '') AS DECIMAL(38,8)))
                  <= CAST('{MAX_DECIMAL}' AS DECIMAL(38,8)) AND x rlike r'{_NUMBER}'
             THEN try_cast(replace(substring(regexp_replace(x, r'{_NUMBER}', '=$1$4$2.$3'), 2), ',', '') AS DECIMAL(38,8)) END,
        CAST(0 AS DECIMAL(38,8)))""",
}


def register(spark: SparkSession) -> list[str]:
    for name, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(DEFINITIONS)
