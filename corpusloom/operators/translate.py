"""Documents through a text provider: protect, chunk, prompt, call, join, restore.

Everything up to the call is columns; calls run in ``mapInArrow`` with one client
for each task.  Where the cluster names a folder in ``spark.checkpoint.dir`` the
answers are written there before they are used, so that a lost executor repeats
only the calls of its unfinished tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.paths import output_path
from ..sources.providers import Echo, Provider, provider_factory, register, with_key  # noqa: F401  providers are registered from here too
from .chunking import MAX_LINES, chunks

TEMPLATE = """You are given part of a documentation file. Render it in {{targetLanguage}}.

Answer with the rendered text alone. Markup, link targets, addresses and field names keep their spelling; code is left alone.
Sentences should read as if they had been written in that language.{{content}}"""
PLACEHOLDERS = """

Marks like __CODE_BLOCK_0__ and __INLINE_CODE_0__ hold the place of code that was taken out.
Copy each of them, letter by letter, to where it belongs."""
_RESPONSE = "content string, model string, prompt_tokens long, completion_tokens long, total_tokens long, finish_reason string, error string"
_ANSWER = [("content", pa.string()), ("model", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("total_tokens", pa.int64()), ("finish_reason", pa.string()), ("error", pa.string())]


def messages(content: Column, lang: Column, has_placeholders: Column, template: str | None = None, glossary_section: Column | None = None) -> Column:
    """System and user message of one chunk."""
    system = X.rendered(F.lit(template or TEMPLATE), {"targetLanguage": lang, "content": F.lit("")})
    if glossary_section is not None:
        system = F.concat(system, F.coalesce(glossary_section, F.lit("")))
    system = F.concat(system, F.when(has_placeholders, F.lit(PLACEHOLDERS)).otherwise(""))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", system), message("user", content))


def split_system(history: Column, assistant: str = "assistant") -> Column:
    """``struct<system, messages>``: the first system message apart; ``assistant`` may get another name."""
    first = F.get(F.filter(history, lambda m: m["role"] == "system"), F.lit(0))["content"]
    rest = F.transform(F.filter(history, lambda m: m["role"] != "system"), lambda m: F.struct(F.when(m["role"] == "assistant", F.lit(assistant)).otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    return F.struct(first.alias("system"), rest.alias("messages"))


def prepared(docs: DataFrame, lang: Column, text_col: str = "text", max_lines: int = MAX_LINES, template: str | None = None, glossary_section: Column | None = None, keep_blank: bool = False) -> DataFrame:
    """One row a chunk: ``row, doc_id, target_lang, frontmatter, entries, chunk_no, n_chunks, messages, error``.

    A null or blank text has one row with an error and no messages.  With ``keep_blank`` only a null
    text has; a blank one is asked for as it is, and has no row if it is longer than a chunk, since
    blank chunks are dropped.  ``row`` numbers the rows of ``docs``, so that rows which repeat an id stay apart.
    """
    t = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lang.alias("target_lang"), X.unix_lines(F.col(text_col)).alias("t"))
    blank = F.col("t").isNull() if keep_blank else F.col("t").isNull() | X.is_blank(F.coalesce("t", F.lit("")))
    t = t.select("row", "doc_id", "target_lang", X.frontmatter(F.col("t")).alias("frontmatter"), X.protect(X.body(F.col("t"))).alias("p"), blank.alias("blank"))
    t = t.withColumn("chunks", F.when(F.col("blank"), F.array(F.lit(None).cast("string"))).otherwise(chunks(F.col("p.text"), max_lines)))
    t = t.select("row", "doc_id", "target_lang", "frontmatter", F.coalesce("p.entries", F.array().cast("array<struct<placeholder:string,original:string>>")).alias("entries"), "blank", F.size("chunks").alias("n_chunks"), F.posexplode_outer("chunks").alias("chunk_no", "chunk"))  # the outer form lets no test of the array's size reach the scan
    asked = messages(F.col("chunk"), F.col("target_lang"), F.size("entries") > 0, template, glossary_section)
    return t.where("chunk_no is not null").select("row", "doc_id", "target_lang", "frontmatter", "entries", "chunk_no", "n_chunks", F.when(~F.col("blank"), asked).alias("messages"), F.when(F.col("blank"), F.lit("Input is empty")).alias("error"))


def called(requests: DataFrame, provider: str = "echo", options: dict | None = None, concurrency: int | None = None) -> DataFrame:
    """``requests`` with the provider's answers; a failed call is an ``error``, not a failed task."""
    options, make = with_key(provider, options or {}), provider_factory(provider)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make(options)
        for batch in batches:
            rows = [answer(client, m, e) for m, e in zip(batch["messages"].to_pylist(), batch["error"].to_pylist())]
            kept = [n for n in batch.schema.names if n not in ("messages", "error")]
            new = [pa.array([r.get(n) for r in rows], k) for n, k in _ANSWER]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *new], [*kept, *(n for n, _ in _ANSWER)])

    def answer(client: Provider, asked: list[dict] | None, error: str | None) -> dict:
        if error is not None:
            return {"error": error}
        try:
            got = client.chat(asked, options)
            content, usage = got["content"], got.get("usage") or {}
        except Exception as e:  # noqa: BLE001  a provider may raise or answer anything
            return {"error": f"No content in the answer: {e}" if isinstance(e, KeyError) else str(e) or type(e).__name__}
        if not isinstance(content, str):
            return {"error": "The answer's content is not a text"}
        return {"content": content, "model": got.get("model"), "finish_reason": got.get("finish_reason")} | {k: usage.get(k) or 0 for k in ("prompt_tokens", "completion_tokens", "total_tokens")}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema if f.name not in ("messages", "error"))
    dealt = requests.repartition(concurrency) if concurrency else requests
    return dealt.mapInArrow(run, f"{schema}, {_RESPONSE}")


def joined(answers: DataFrame, separator: str = "", exact: bool = False) -> DataFrame:
    """One row a document: ``content``, token sums, ``chunks`` and the first ``error``.

    ``separator`` stands between chunks: nothing by default, a line end to lose none.
    """
    own = answers.groupBy("row", "doc_id", "target_lang").agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("c"), F.first("frontmatter").alias("frontmatter"), F.first("entries").alias("entries"), F.count("*").alias("chunks"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")], F.min_by("error", "chunk_no").alias("e0"), F.max("error").alias("e1"),
    )
    text = F.array_join(F.transform("c", lambda x: x["content"]), separator)
    whole = F.concat(F.coalesce("frontmatter", F.lit("")), X.restore(text, F.col("entries"), exact))
    error = F.coalesce("e0", "e1")
    return own.select("doc_id", "target_lang", F.when(error.isNull(), whole).alias("content"), "chunks", "prompt_tokens", "completion_tokens", "total_tokens", error.alias("error"))


def translate(docs: DataFrame, lang: str, provider: str = "echo", options: dict | None = None, **how) -> DataFrame:
    """Translations of all documents; a failure stays with its document."""
    shape = {k: how.pop(k) for k in ("separator", "exact") if k in how}
    concurrency = how.pop("concurrency", None)
    answers = called(prepared(docs, F.lit(lang), **how), provider, options, concurrency)
    if docs.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None):
        answers = answers.checkpoint()
    return joined(answers, **shape)


def planned(docs: DataFrame, lang: str, output_dir: str | None = None, base: str | None = None) -> DataFrame:
    """What a run would write, without calls: ``path, output_path, error``."""
    out = output_path(F.col("path"), F.lit(lang), F.lit(output_dir).cast("string"), F.lit(base).cast("string"))
    return docs.select("path", out.alias("o")).select("path", F.col("o.path").alias("output_path"), F.col("o.error").alias("error"))


def summary(results: DataFrame) -> DataFrame:
    """One row: ``total, succeeded, failed, errors``, errors as an array of ``struct<doc_id, error>``."""
    bad = F.col("error").isNotNull()
    return results.agg(F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"), F.array_sort(F.collect_list(F.when(bad, F.struct("doc_id", "error")))).alias("errors"))
