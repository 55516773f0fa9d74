"""Views of the benchmark tables in the engine's own model, the same text for Spark and for the oracle's engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# {T} is a timestamp in microseconds by 10,000 (one synthetic second is 10,000 real ones); "div" is integer division
_EVENTS = "(SELECT event_id, user_id, event_type, value, {T} AS t_us, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"
_KIND = "CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'clap' ELSE 'move' END"

VIEWS: dict[str, str] = {
    "ev": _EVENTS,
    "cursor_sparse": f"(SELECT user_id AS session_id, event_id AS row_seq, t_us, value / 500 AS x, CAST(k AS DOUBLE) / 100 AS y, {_KIND} AS event FROM {_EVENTS} a)",
    "cursor_dense": f"(SELECT user_id % 8 AS session_id, event_id AS row_seq, t_us, value / 5000 AS x, CAST(k AS DOUBLE) / 10000 AS y, {_KIND} AS event FROM {_EVENTS} a)",
    "detections": f"(SELECT user_id AS session_id, event_type AS detector, event_id, t_us AS s, t_us + CAST(floor(value * 60000) AS BIGINT) AS e FROM {_EVENTS} a)",
    "durations": f"(SELECT user_id AS session_id, max(t_us) + 5000000 AS duration FROM {_EVENTS} a GROUP BY user_id)",
    "limits": f"(SELECT user_id % 8 AS session_id, max(t_us) - 500000 AS lim FROM {_EVENTS} a GROUP BY user_id % 8)",
    "layout": "(SELECT session_id, s, e, layout, CAST(1 AS DOUBLE) AS speed FROM (SELECT user_id AS session_id, t_us AS s, lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS e, "
    f"CASE event_id % 3 WHEN 0 THEN 'cam_full' WHEN 1 THEN 'pip' ELSE 'screen_full' END AS layout FROM {_EVENTS} a) b WHERE e > s)",
    "ragged": "(SELECT session_id, s, greatest(s + 1, e + (k - 50) * 40000) AS e, layout FROM (SELECT user_id AS session_id, k, t_us - (SELECT min(t_us) FROM {EV} m) + 1000 AS s, "
    "lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) - (SELECT min(t_us) FROM {EV} m) + 1000 AS e, CASE event_id % 3 WHEN 0 THEN 'cam_full' WHEN 1 THEN 'pip' ELSE 'screen_full' END AS layout FROM {EV} a) b WHERE e > s)",
    "cuts": f"(SELECT user_id AS session_id, t_us AS s, t_us + CAST(floor(value * 20000) AS BIGINT) AS e FROM {_EVENTS} a WHERE event_type = 'click')",
    "zones": "(SELECT session_id, s, e, event_id AS zone_seq, CASE WHEN detector = 'view' THEN 'junk' WHEN e - s > 20000000 THEN 'cut' WHEN e - s > 10000000 THEN 'speed@8x' ELSE 'speed@4x' END AS action FROM {DETECTIONS} d WHERE detector IN ('purchase', 'view'))",
    "hints": f"(SELECT user_id AS session_id, event_id AS hint_id, t_us AS s, t_us + CAST(floor(value * 20000) AS BIGINT) AS e, CASE k % 4 WHEN 0 THEN 'soft' WHEN 1 THEN 'normal' WHEN 2 THEN 'strong' ELSE 'odd' END AS strength FROM {_EVENTS} a WHERE event_type = 'purchase')",
    "zooms": f"(SELECT user_id AS session_id, t_us - 1000000 AS s, t_us + CAST(floor(value * 20000) AS BIGINT) AS e, 1.0 + CAST(k % 4 AS DOUBLE) / 4 AS zoom, CAST(k AS DOUBLE) / 100 AS cx, value / 500 AS cy FROM {_EVENTS} a WHERE event_type <> 'click')",
    "samples": f"(SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS idx, value > 50 AS ok, value AS v, t_us FROM {_EVENTS} a)",
    "boxes": "(SELECT p_partkey % 20 AS session_id, p_partkey % 7 AS second, p_partkey AS box_seq, CAST(p_size * 20 AS DOUBLE) AS x, CAST(p_partkey % 1080 AS DOUBLE) AS y, 40.0E0 AS w, 20.0E0 AS h FROM part)",
    "centres": f"(SELECT user_id % 20 AS session_id, event_id AS point_id, event_id % 7 AS second, value / 500 AS cx, CAST(k AS DOUBLE) / 100 AS cy FROM {_EVENTS} a)",
    "vectors": "(SELECT vec_id div 100 AS session_id, vec_id % 100 AS idx, embedding AS v FROM embeddings)",
    "sents": "(SELECT vec_id div 100 AS session_id, vec_id % 100 AS idx, (vec_id % 100) * 5000000 AS s, (vec_id % 100) * 5000000 + 4000000 AS e, concat(' s', CAST(vec_id AS {STRING}), ' ') AS text FROM embeddings)",
    "chats": "(SELECT conv_id AS session_id, conv_id, text FROM (SELECT conv_id, {AGG} AS text0 FROM conversations GROUP BY conv_id) a, LATERAL (SELECT concat(text0, CASE conv_id % 5 WHEN 0 THEN ' look at this, right here' "
    "WHEN 1 THEN ' what if' WHEN 2 THEN ' notice' WHEN 3 THEN ' Look At right here what if' ELSE '' END, repeat('!', CAST(conv_id % 7 AS INT))) AS text) b)",
}


def view(name: str, spark: bool) -> str:
    """A view's query for one of the two engines."""
    text = VIEWS[name]
    while any(k in text for k in ("{EV}", "{DETECTIONS}")):
        text = text.replace("{EV}", VIEWS["ev"]).replace("{DETECTIONS}", VIEWS["detections"])
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)" if spark else "epoch_us(ts)"
    agg = "array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), ' ')" if spark else "string_agg(text, ' ' ORDER BY turn, text)"
    text = text.replace("{T}", f"({micros} div 10000)").replace("{AGG}", agg).replace("{STRING}", "STRING" if spark else "VARCHAR")
    return text if spark else text.replace(" div ", " // ")


class Source:
    """The benchmark tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        tables = {t: self.table(t) for t in ("events", "part", "embeddings", "conversations") if f" {t}" in view(name, True)}
        text = view(name, True)
        for t in tables:
            for end in (")", " "):
                text = text.replace(f"FROM {t}{end}", f"FROM {{{t}}}{end}")
        return self.spark.sql(text[1:-1], **tables)


def oracle(text: str) -> str:
    """An oracle's SQL with @name for each view."""
    for name in sorted(VIEWS, key=len, reverse=True):
        text = text.replace(f"@{name}", view(name, False))
    return text
