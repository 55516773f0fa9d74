"""Scalar expressions on text, scores and media strings, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cue phrases decide a clip's layout.
DEMO_CUES = "look at|right here|over here|see this|see how|notice|check this|this part|this line|this button|on the screen|in the terminal"
HOOK_CUES = "what if|imagine|here's the thing|turns out|but here|let me tell|story time|I'll show you"
_NUMBER = r"[:=]\s*([0-9]+(?:\.[0-9]+)?)"


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


def log_intervals(text: Column, kind: str) -> Column:
    """Array of (s, e) microseconds from a detector's log: the i-th <kind>_start goes with the i-th <kind>_end, what isn't closed
    or doesn't last is dropped."""
    starts, ends = (F.regexp_extract_all(text, F.lit(f"{kind}_{w}{_NUMBER}"), F.lit(1)) for w in ("start", "end"))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(micros(a.cast("double")).alias("s"), micros(b.cast("double")).alias("e")))
    return F.filter(pairs, lambda p: p["s"].isNotNull() & p["e"].isNotNull() & (p["e"] > p["s"]))


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), F.lit(" \t\n\r"))


def extract_json(text: Column) -> Column:
    """From the first brace to the one that balances it (braces in strings count too); null where there is none."""
    from_first = F.regexp_extract(text, r"(?s)\{.*", 0)
    parts = F.regexp_extract_all(from_first, F.lit(r"([{}][^{}]*)"), F.lit(1))  # each begins with a brace
    state = lambda depth, size, done: F.struct(depth.alias("depth"), size.alias("size"), done.alias("done"))

    def step(a: Column, part: Column) -> Column:
        depth = a["depth"] + F.when(F.startswith(part, F.lit("{")), 1).otherwise(-1)
        return F.when(a["done"], a).when(depth == 0, state(depth, a["size"] + 1, F.lit(True))).otherwise(state(depth, a["size"] + F.length(part), F.lit(False)))

    end = F.aggregate(parts, state(F.lit(0), F.lit(0), F.lit(False)), step)
    return F.when(end["done"], F.substring(from_first, F.lit(1), end["size"]))


def slugify(title: Column, most: int = 40) -> Column:
    t = F.regexp_replace(F.lower(F.trim(title)), "[^a-zA-Z0-9]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.left(F.when(t == "", "clip").otherwise(t), F.lit(most))


def ass_time(us: Column) -> Column:
    """h:mm:ss.cc, half-even hundredths of the seconds."""
    h, m = F.floor(us / 3_600_000_000), F.floor(us % 3_600_000_000 / 60_000_000)
    cs = F.bround(us % 60_000_000 / 10_000).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", h, m, F.floor(cs / 100), cs % 100)


def karaoke(word: Column, s: Column, e: Column) -> Column:
    cs = F.greatest(F.lit(1), F.bround((e - s) / 10_000).cast("long"))
    return F.concat(F.lit("{\\kf"), cs.cast("string"), F.lit("}"), F.trim(word))


def punctuation_density(text: Column) -> Column:
    n = F.length(text)
    marks = n - F.length(F.translate(text, "?!", ""))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), marks / F.greatest(n / 100, F.lit(1.0)) / 5))


def length_preference(d: Column, low: float, high: float) -> Column:
    return F.when((d >= low) & (d <= high), 1.0).when(d < low, F.greatest(F.lit(0.0), d / low)).otherwise(F.greatest(F.lit(0.0), 1 - (d - high) / high))


def composite(llm: Column, audio: Column, punct: Column, length: Column) -> Column:
    """Weighted score; without a model's score (null) the rest is rescaled."""
    rest = 0.20 * audio + 0.15 * punct + 0.10 * 0.5 + 0.10 * length
    return F.when(llm.isNull(), rest / 0.55).otherwise(0.45 * llm / 10 + rest)


def pick_layout(text: Column, dual: Column, default: str = "split_vstack") -> Column:
    count = lambda cues: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b({cues})\b"))
    return F.when(~dual, "screen_full").when(count(DEMO_CUES) >= 2, "split_vstack").when((count(HOOK_CUES) >= 1) & (count(DEMO_CUES) == 0), "cam_full").otherwise(default)


def sec_to_frame(seconds: Column, fps: Column) -> Column:
    return F.bround(seconds * fps).cast("long")


def atempo_chain(speed: Column) -> Column:
    """Factors of at most 2 whose product is the speed, as filter strings; none for 1, null outside [0.5, 16]."""
    halves = F.when(speed > 2 + 1e-6, F.ceil(F.log2(speed / (2 + 1e-6)))).otherwise(0).cast("int")
    rest = speed / F.pow(F.lit(2.0), halves)
    last = F.when(F.abs(rest - 1) > 1e-6, F.array(F.concat(F.lit("atempo="), shortest(rest)))).otherwise(F.array().cast("array<string>"))
    chain = F.concat(F.array_repeat(F.lit("atempo=2"), halves), last)
    return F.when(F.abs(speed - 1) < 1e-6, F.array().cast("array<string>")).when((speed >= 0.5) & (speed <= 16), chain)


def shortest(x: Column, digits: int = 6) -> Column:
    """A number of at least 0.0001 with up to ``digits`` significant places and no trailing zeros."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4)))).cast("int"))
    text = F.format_string("%.10f", F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def zoom_crop(zoom: Column, cx: Column, cy: Column, w: int, h: int) -> Column:
    cw, ch = w / zoom, h / zoom
    x = F.greatest(F.lit(0.0), F.least(w - cw, cx * w - cw / 2))
    y = F.greatest(F.lit(0.0), F.least(h - ch, cy * h - ch / 2))
    return F.format_string("crop=%.3f:%.3f:%.3f:%.3f", cw, ch, x, y)


def smoothstep_zoom(t: Column, length: Column, zoom: Column, ease: float = 0.35) -> Column:
    """Zoom factor at local time t of a piece: in over ``ease`` seconds, hold, out again."""
    u = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / ease))
    step = lambda x: 3 * x * x - 2 * x * x * x
    return 1 + (zoom - 1) * F.least(step(u(t)), step(u(length - t)))


def encoder_flags(encoder: Column) -> Column:
    return F.when(encoder.startswith("hevc"), "-tag:v hvc1").when(encoder == "libx264", "-preset ultrafast").otherwise("")


def fingerprint(data: Column, chunk: int = 1 << 20) -> Column:
    """First 16 hex places of the sha256 of the size, the first MiB and, above two MiB, the last MiB."""
    size = F.octet_length(data)
    last = F.when(size > 2 * chunk, F.substring(data, size - chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return F.left(F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(data, F.lit(1), F.lit(chunk)), last), 256), F.lit(16))


def scale_fill(w: int, h: int) -> str:
    return f"scale={w}:{h}:force_original_aspect_ratio=increase,crop={w}:{h}"
