"""Filling fields by a language model of one's own.

The engine makes prompts and reads answers as DataFrames; the call is a function that each worker makes for itself, so a
client, a key or a local model lives in the worker. Answers are kept by the hash of their prompt: what is cached isn't asked again, and
a retried task only asks what no finished task has answered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import fields
from cellweave.functions.text import chunks, plain_answer, without_fence
from cellweave.sources.cache import through_cache
from cellweave.sources.shared import cut

#: (system prompt, user prompt) to an answer.
Call = Callable[[str, str], str]
TOO_LONG = re.compile(r"context[ _]length|context window|maximum context|too many tokens|token limit|too large", re.IGNORECASE)


def field_hint(kind: str, codes: Mapping[str, str] | None = None) -> str:
    """What a field's value is to be, with its codes."""
    told = fields.KINDS[kind]
    return told + "; codes: " + ", ".join(f"{code} = {meaning}" for code, meaning in codes.items()) if codes else told


def schema_prompt(kinds: Mapping[str, str] = fields.FIELDS, codes: Mapping[str, Mapping[str, str]] = fields.CODES) -> str:
    return "{\n" + ",\n".join(f'  "{name}": "<{field_hint(kind, codes.get(name))}>"' for name, kind in kinds.items()) + "\n}"


def guidance_prompt(guidance: Mapping[str, str]) -> str:
    return "\n".join(f"- {name}: {text}" for name, text in guidance.items() if text)


def system_prompt(kinds: Mapping[str, str] = fields.FIELDS, guidance: Mapping[str, str] | None = None, examples: Sequence[Mapping] = ()) -> str:
    parts = ["Read the paper and answer with one JSON object of these fields, null where the paper says nothing:", schema_prompt(kinds)]
    if guidance:
        parts.append(guidance_prompt(guidance))
    parts += ["Example:\n" + json.dumps(dict(e), ensure_ascii=False) for e in examples]
    return "\n\n".join(parts)


def verifier_prompt() -> str:
    return "For each field of the record say whether the paper has its value: " + ", ".join(fields.VERDICTS) + ". Quote the passage. Answer with a JSON object of objects with verdict and quote."


def block_line(page: Column, bbox: Column, text: Column) -> Column:
    return F.concat(F.lit("[p"), page.cast("string"), F.lit(" bbox{"), F.array_join(F.transform(bbox, lambda x: x.cast("string")), ", "), F.lit("}] "), text)


def block_prompts(blocks: DataFrame, most_characters: int = 8000) -> DataFrame:
    """(file, prompt): a document's blocks in order, cut after so many characters, which is what the model is given."""
    lines = F.array_sort(F.collect_list(F.struct("ord", block_line(F.col("page"), F.col("bbox"), F.col("text")).alias("line"))))
    return blocks.groupBy("file").agg(F.substring(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 1, most_characters).alias("prompt"))


def chunk_prompts(texts: DataFrame, size: int) -> DataFrame:
    """(key, part, prompt): whole texts in chunks."""
    return texts.select("key", F.posexplode(chunks(F.col("text"), size)).alias("part", "prompt"))


def needs_fallback(message: str) -> bool:
    """Whether an error says that a prompt was too long."""
    return bool(TOO_LONG.search(message))


def parsed(call: Call, system: str, prompt: str, tries: int = 3) -> str:
    """A call's answer as a JSON object's text; asked again if it doesn't parse. An error of the call itself isn't repeated here."""
    last: ValueError | None = None
    for _ in range(tries):
        answer = call(system, prompt)
        try:
            value = json.loads(plain_answer(answer))
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
            last = ValueError("the answer is no JSON object")
        except ValueError as e:
            last = e
    raise ValueError(f"no valid answer in {tries} tries: {last}")


def prompt_id(system: str, model: str) -> Column:
    """The SHA-256 of model, system prompt and the column prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(system), "prompt"), 256)


def answers(prompts: DataFrame, make_call: Callable[[], Call], system: str, model: str, cache: DataFrame | None = None, tries: int = 3) -> DataFrame:
    """(id, answer, error) for prompts (prompt, ...): id is prompt_id's. A document's failure is told, not raised.

    cache: answers of earlier runs; what it has isn't asked. tries: how often an answer that doesn't parse is asked for; with none, answers are as they come."""
    named = prompts.select(prompt_id(system, model).alias("id"), "prompt").dropDuplicates(["id"])
    todo = named if cache is None else named.join(cache.where("answer IS NOT NULL").select("id"), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in batches:
            call = call or make_call()
            out = []
            for prompt in batch.column(1).to_pylist():
                try:
                    out.append((parsed(call, system, prompt, tries) if tries else call(system, prompt), None))
                except Exception as e:  # told by document, so that others go on
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["id", "answer", "error"])

    new = todo.mapInArrow(run, "id string, answer string, error string")
    return new if cache is None else new.unionByName(cache.select("id", "answer", "error").join(named.select("id"), "id", "left_semi"))


def cached_answers(prompts: DataFrame, path: str, make_call: Callable[[], Call], system: str, model: str, tries: int = 3) -> tuple[DataFrame, int]:
    """answers, kept in a folder by their ids, and how many prompts were asked now. Failures aren't kept, so the next run asks again."""
    named = prompts.select(prompt_id(system, model).alias("id"), "prompt").dropDuplicates(["id"])
    failed: list[DataFrame] = []

    def ask(todo: DataFrame) -> DataFrame:
        asked = cut(answers(todo, make_call, system, model, tries=tries))
        failed.append(asked.where("answer IS NULL"))
        return asked

    kept, asked = through_cache(named, path, ask, key="id", keep=F.col("answer").isNotNull())
    return kept.unionByName(failed[0]) if asked else kept, asked


#: What a part of a paper is asked, and how the parts' answers are put together.
PART = "This is part {} of {} of one paper. Answer with one JSON object of what it says of the fields, null where it says nothing.\n\nTEXT:\n"
TOGETHER = "Parts of one paper were read one by one. Put their answers together into one JSON object of the same fields: of several values the one that most parts give, or the most exact one; lists without repeats.\n\nANSWERS:\n"


def synthesised(texts: DataFrame, make_call: Callable[[], Call], system: str, model: str, size: int = 20000, most_characters: int = 60000, tries: int = 3) -> DataFrame:
    """(key, answer, error) of texts (key, text) of any length: their chunks' answers, put together level by level by prompts of bounded size.

    A level takes neighbouring answers as far as most_characters reach, two at least, so levels follow the logarithm of a text's length; each level is kept. A document
    fails with any of its parts. Blank texts have no answer."""
    parts = chunk_prompts(texts.where(F.trim("text") != ""), size)
    counted = parts.join(parts.groupBy("key").agg(F.count("*").alias("n")), "key")
    asked = counted.select("key", "part", F.concat(F.format_string(PART.replace("{}", "%s"), F.col("part") + 1, F.col("n")), "prompt").alias("prompt"))

    def told(prompts: DataFrame, tries: int) -> DataFrame:
        got = answers(prompts, make_call, system, model, tries=tries)
        return cut(prompts.withColumn("id", prompt_id(system, model)).join(got, "id").select("key", "part", "answer", "error"))

    level, done = told(asked, 0), None
    while True:
        bad = level.where("error IS NOT NULL").groupBy("key").agg(F.min("error").alias("error"))
        good = level.join(bad.select("key"), "key", "left_anti")
        by = Window.partitionBy("key").orderBy("part")  # the parts of one document
        before = F.coalesce(F.sum(F.length("answer") + 3).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        group = F.least(F.floor(before / most_characters), F.floor((F.row_number().over(by) - 1) / 2)).cast("int")
        listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("part", "answer"))), lambda x: x["answer"]))
        prompts = good.withColumn("group", group).groupBy("key", F.col("group").alias("part")).agg(F.concat(F.lit(TOGETHER), listed).alias("prompt"))
        last = told(prompts, tries)
        alone = last.groupBy("key").agg(F.count("*").alias("n"), F.max("answer").alias("answer"), F.max("error").alias("error"))
        ended = alone.where("n = 1").select("key", "answer", "error").unionByName(bad.select("key", F.lit(None).cast("string").alias("answer"), "error"))
        done = cut(ended if done is None else done.unionByName(ended))
        level = cut(last.join(alone.where("n > 1").select("key"), "key", "left_semi"))
        if level.isEmpty():
            return done


#: (system prompt, instruction, page images) to an answer.
ImageCall = Callable[[str, str, Sequence[str]], str]


def rungs(dpi: int = 150, most_pages: int | None = None) -> list[tuple[int, int | None]]:
    """Resolutions and page limits to try one after the other: first smaller images, then fewer pages."""
    smaller = [d for d in (max(dpi // 2, 72), 72) if d < dpi]
    return [(dpi, most_pages), *((d, most_pages) for d in smaller), (72, min(most_pages or 40, 40))]


def verdicts_of(answer: str, wanted: Sequence[str] = tuple(fields.FIELDS)) -> dict[str, dict[str, str]]:
    """Verdicts and quotes by field from a verifier's answer; verdicts that aren't known ones count as not_in_text."""
    told = json.loads(plain_answer(answer))
    if not isinstance(told, dict):
        raise ValueError("the answer is no JSON object")
    out = {}
    for name in wanted:
        one = told.get(name)
        one = one if isinstance(one, dict) else {}
        verdict = str(one.get("verdict", "")).strip().lower()
        out[name] = {"verdict": verdict if verdict in fields.VERDICTS else "not_in_text", "quote": str(one.get("quote") or "")}
    return out


def verified(documents: DataFrame, render: Callable[[DataFrame, int, int | None], DataFrame], make_call: Callable[[], ImageCall], dpi: int = 150, most_pages: int | None = None, tries: int = 3, wanted: Sequence[str] = tuple(fields.FIELDS)) -> DataFrame:
    """(key, state, rung, verdicts, error) of documents (key, record as JSON, ...): records checked against their pages' images.

    render gives (key, images) of documents at a resolution, for at most so many pages. If it gives the documents' record, too, images stay where they are made; else they are dealt
    by key, as they are far larger than what they are told by, and never broadcast. Each rung of ``rungs`` gets the documents that were too long on the one before, and is kept.
    state: verified, no_pages, failed (with another error, which isn't tried again) or too_long (on the last rung, too). verdicts is JSON by field; rung counts from 0."""
    system, steps = verifier_prompt(), rungs(dpi, most_pages)
    todo, done = documents, None

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in batches:
            out = []
            for record, images in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not images:
                    out.append(("no_pages", None, None))
                    continue
                call = call or make_call()
                instruction, last = "Check these values against the pages:\n" + (record or "{}"), None
                try:
                    for _ in range(tries):
                        answer = call(system, instruction, images)
                        try:
                            out.append(("verified", json.dumps(verdicts_of(answer, wanted), ensure_ascii=False), None))
                            break
                        except ValueError as e:
                            last = e
                    else:
                        out.append(("failed", None, f"no valid answer in {tries} tries: {last}"))
                except Exception as e:  # told by document, so that others go on
                    out.append(("too_long" if needs_fallback(str(e)) else "failed", None, f"{type(e).__name__}: {e}"[:500]))
            columns = [batch.column(0), *(pa.array([x[k] for x in out], pa.string()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "state", "verdicts", "error"])

    kind = documents.schema["key"].dataType.simpleString()
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for rung, (at, pages) in enumerate(steps):
        shown = render(todo, at, pages)
        whole = "record" in shown.columns
        if whole:
            shown = shown.select("key", "record", "images")
        else:
            # so many partitions whatever their size, as images may be small when compressed
            shown = todo.select("key", "record").repartition(tasks, "key").join(shown.select("key", "images").repartition(tasks, "key").hint("merge"), "key", "left")
        told = cut(shown.mapInArrow(check, f"key {kind}, state string, verdicts string, error string").select("key", "state", F.lit(rung).alias("rung"), "verdicts", "error"))
        settled = told if rung + 1 == len(steps) else told.where("state <> 'too_long'")
        if whole:
            # documents that the render has left out have no pages
            none = [F.lit(x).cast(t).alias(c) for c, x, t in (("state", "no_pages", "string"), ("rung", rung, "int"), ("verdicts", None, "string"), ("error", None, "string"))]
            settled = settled.unionByName(todo.select("key").join(told.select("key"), "key", "left_anti").select("key", *none))
        done = settled if done is None else done.unionByName(settled)
        todo = todo.join(told.where("state = 'too_long'").select("key"), "key", "left_semi").repartition(tasks, "key")
    return done


def call_from(conf: Mapping[str, str], local: Callable[[], Call] | None = None) -> Callable[[], Call]:
    """The model that settings name: a chat service (``url``, ``key``, ``model``) comes first, then one's own local model. most_tokens bounds an answer of either."""
    if conf.get("url", "").strip():
        headers = {"Authorization": f"Bearer {conf['key'].strip()}"} if conf.get("key", "").strip() else None
        return http_call(conf["url"].strip(), headers, conf.get("model", ""), int(conf.get("most_tokens", 4096)))
    if local is not None:
        return local
    raise RuntimeError("name a chat service's url, or give a local model")


#: Which prompts a run of setups uses.
SETUPS = {"zero": ("zero_shot",), "few": ("few_shot",), "both": ("zero_shot", "few_shot")}


def run_setups(which: str, texts: DataFrame, make_call: Callable[[], Call], model: str, examples: Sequence[Mapping] = (), mode: str = "blocks", most_characters: int = 8000, size: int = 20000, fallback: bool = False, **options) -> dict[str, DataFrame]:
    """(key, record, error) by setup, without and with examples, of texts (key, text).

    mode: ``blocks`` cuts a text, ``full_text`` reads it in chunks, ``whole`` gives all of it; with fallback, what is too long whole is read in chunks."""
    if mode not in ("blocks", "full_text", "whole"):
        raise ValueError("a mode is blocks, full_text or whole")
    out = {}
    for setup in SETUPS[which]:
        system = system_prompt(examples=examples if setup == "few_shot" else ())
        in_chunks = lambda t, system=system: synthesised(t, make_call, system, model, size, **options)
        if mode == "full_text":
            told = in_chunks(texts)
        else:
            prompts = texts.where(F.trim("text") != "").select("key", (F.substring("text", 1, most_characters) if mode == "blocks" else F.col("text")).alias("prompt"))
            named = prompts.withColumn("id", prompt_id(system, model))
            told = cut(named.select("key", "id").join(answers(prompts, make_call, system, model), "id").select("key", "answer", "error"))
            if fallback and mode == "whole":
                long = told.where(F.col("error").rlike("(?i)" + TOO_LONG.pattern)).select("key")
                told = told.join(long, "key", "left_anti").unionByName(in_chunks(texts.join(long, "key", "left_semi")))
        out[setup] = told.join(records(told.where("answer IS NOT NULL").withColumn("id", F.col("key"))).withColumnRenamed("id", "key"), "key", "left").select("key", "record", "error")
    return out


def with_fallback(first: DataFrame, prompts: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first with the answers that failed as too long asked again by shorter prompts. prompts: (id, ...)."""
    failed = first.where(F.col("error").rlike("(?i)" + TOO_LONG.pattern)).select("id")
    return first.join(failed, "id", "left_anti").unionByName(again(prompts.join(failed, "id", "left_semi")))


def records(answered: DataFrame, wanted: Sequence[str] = tuple(fields.FIELDS)) -> DataFrame:
    """(id, record): answers as variants with all fields, absent ones null."""
    record = F.try_parse_json(without_fence(F.col("answer")))
    get = [F.try_variant_get(record, f"$['{name}']", "variant").alias(name) for name in wanted if "'" not in name]
    return answered.select("id", F.to_json(F.struct(*get), {"ignoreNullFields": "false"}).alias("record"))


def http_call(url: str, headers: Mapping[str, str] | None = None, model: str = "", most_tokens: int = 4096, timeout: float = 180) -> Callable[[], Call]:
    """Makes calls to a chat service with the widespread messages interface."""

    def make() -> Call:
        import urllib.request

        def call(system: str, prompt: str) -> str:
            body = {"model": model, "max_tokens": most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]

        return call

    return make


def post_files(files: DataFrame, url: str, field: str = "input", timeout: float = 180) -> DataFrame:
    """(key, xml, error): each file's answer from a service that takes multipart uploads, such as one that makes TEI of PDFs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.request
        import uuid

        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = uuid.uuid4().hex
                head = f'--{mark}\r\nContent-Disposition: form-data; name="{field}"; filename="{name}"\r\nContent-Type: application/pdf\r\n\r\n'
                request = urllib.request.Request(url, head.encode() + content + f"\r\n--{mark}--\r\n".encode(), {"Content-Type": f"multipart/form-data; boundary={mark}"})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        out.append((name, answer.read().decode("utf-8"), None))
                except OSError as e:
                    out.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["key", "xml", "error"])

    return files.select("file", "content").mapInArrow(run, "key string, xml string, error string")
