"""Model calls as pluggable functions: rows in, validated rows out.

A client is any callable from a prompt to an answer's text.  It is created once for each task by a factory that is shipped to
the executors, tried several times, and a row whose every try fails or doesn't validate comes back with a null answer."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.text import extract_json, strip_thinking
from tempograph.operators.intervals import fill_coverage
from tempograph.sources.readers import SCHEMAS, us
from tempograph.sources.writers import nested, seconds

Client = Callable[[str], str]


def has(*fields: str) -> Callable[[str], bool]:
    """Whether an answer's first JSON object has these fields."""

    def valid(answer: str) -> bool:
        text = re.sub(r"(?s)<think>.*?</think>", "", answer)
        found, _ = json.JSONDecoder().raw_decode(text, text.index("{"))
        return all(f in found for f in fields)

    return valid


def call(prompts: DataFrame, factories: list[Callable[[], Client]], tries: int = 3, wait: float = 1.0, valid: Callable[[str], bool] | None = None) -> DataFrame:
    """Adds ``answer`` to rows with ``prompt``: the first client's that answers, and whose answer is ``valid``; each is tried ``tries`` times."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = [f() for f in factories]

        def one(prompt: str) -> str | None:
            for client in clients:
                for n in range(tries):
                    try:
                        answer = client(prompt)
                        if valid is None or valid(answer):
                            return answer
                    except Exception:  # a client may fail in any way; the next try or client answers
                        pass
                    if n + 1 < tries:
                        time.sleep(wait)
            return None

        for pdf in batches:
            yield pdf.assign(answer=pdf.prompt.map(one))

    return prompts.mapInPandas(ask, f"{', '.join(f'`{n}` {t}' for n, t in prompts.dtypes)}, answer string")


def transcript_prompts(words: DataFrame, task: str) -> DataFrame:
    """One prompt for each session: the task and its words as JSON."""
    docs = nested(words, "words", "word_idx", F.col("word_idx").alias("i"), F.col("word").alias("w"), seconds("s").alias("s"), seconds("e").alias("e"))
    return docs.select("session_id", F.concat(F.lit(task + "\n"), F.to_json("words")).alias("prompt"))


def analyse(words: DataFrame, task: str, schema: str, field: str, factories: list[Callable[[], Client]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """One row for each item of the array ``field`` in the model's JSON answers, parsed by ``schema``."""
    said = call(transcript_prompts(words, task), factories, tries, wait, has(field))
    parsed = said.select("session_id", F.from_json(extract_json(strip_thinking(F.col("answer"))), schema).alias("j"))
    return parsed.select("session_id", F.inline(f"j.{field}"))


def layout_plan(words: DataFrame, totals: DataFrame, task: str, factories: list[Callable[[], Client]], **how) -> DataFrame:
    """The model's layout segments (s, e, layout), made to cover each session of ``totals`` (session_id, total) exactly; a session without an
    answer has the default layout throughout."""
    got = analyse(words, task, SCHEMAS["layout_plan"], "segments", factories, **how).where("start is not null and end is not null")
    return fill_coverage(got.select("session_id", us("start").alias("s"), us("end").alias("e"), "layout"), totals)


def zoom_hints(words: DataFrame, task: str, factories: list[Callable[[], Client]], **how) -> DataFrame:
    """The model's moments to zoom in on: session_id, anchor_word_idx, s, e, strength, reason."""
    got = analyse(words, task, SCHEMAS["zoom_hints"], "hints", factories, **how).where("start is not null and end is not null")
    return got.select("session_id", "anchor_word_idx", us("start").alias("s"), us("end").alias("e"), "strength", "reason")


def dead_zone_cues(words: DataFrame, task: str, factories: list[Callable[[], Client]], **how) -> DataFrame:
    """What the model says may be skipped: session_id, s, e, reason, confidence (high unless it says low)."""
    got = analyse(words, task, SCHEMAS["dead_zone_cues"], "cues", factories, **how).where("start is not null and end is not null")
    return got.select("session_id", us("start").alias("s"), us("end").alias("e"), "reason", F.when(F.col("confidence") == "low", "low").otherwise("high").alias("confidence"))


SCORE = "score double, title string, reason string, start_offset double, end_offset double"


def score_clips(clips: DataFrame, task: str, factories: list[Callable[[], Client]], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds llm, title, reason, effective_s and effective_e to clips (s, e, text): the model's score from 0 to 10 and the clip without its
    offsets; all null, or the clip as it is, where no answer holds."""
    prompt = F.concat(F.lit(task + "\n"), F.to_json(F.struct(seconds("s").alias("start"), seconds("e").alias("end"), F.col("text").alias("transcript"))))
    said = call(clips.withColumn("prompt", prompt), factories, tries, wait, has("score"))
    j = F.from_json(extract_json(strip_thinking(F.col("answer"))), SCORE)
    out = said.withColumn("_j", j).withColumn("_j", F.when(F.col("_j.score").between(0, 10), F.col("_j")))
    text = lambda c: F.when(F.col("_j").isNotNull(), F.coalesce(F.col(f"_j.{c}"), F.lit(""))).alias(c)
    offset = lambda c: F.coalesce(us(f"_j.{c}"), F.lit(0))
    return out.select(*clips.columns, F.col("_j.score").alias("llm"), text("title"), text("reason"), (F.col("s") + offset("start_offset")).alias("effective_s"), (F.col("e") - offset("end_offset")).alias("effective_e"))


def embed(sentences: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Adds ``v``, a model's vector for each text; the model is loaded once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            yield pdf.assign(v=list(model(pdf.text.tolist())))

    return sentences.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in sentences.dtypes)}, v array<double>")
