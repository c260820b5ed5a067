"""Adapters that map known corpora onto the canonical row, and featurisers of preference and chat data."""

from __future__ import annotations

import base64
import pickletools
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import answers as A
from ..functions import text as T
from .curation import messages


def _row(source: Column, prompt: Column, ability: str, truth: Column, extra: Column, style: str = "rule") -> list[Column]:
    return [source.alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), extra.alias("extra_info")]


def word_problems(df: DataFrame, instruction: str, split: str, index: str = "index") -> DataFrame:
    """question / answer rows whose answer ends in ``#### number``."""
    prompt = messages(("user", F.concat_ws(" ", "question", F.lit(instruction))))
    extra = F.struct(F.lit(split).alias("split"), F.col(index).alias("index"), F.col("answer"), F.col("question"))
    return df.select(*_row(F.lit("gsm8k"), prompt, "math", A.gsm_truth("answer"), extra))


def boxed_problems(df: DataFrame, instruction: str, split: str, index: str = "index") -> DataFrame:
    """problem / solution rows whose truth is the solution's last box."""
    prompt = messages(("user", F.concat_ws(" ", "problem", F.lit(instruction))))
    return df.select(*_row(F.lit("math"), prompt, "math", A.last_boxed_content("solution"), F.struct(F.lit(split).alias("split"), F.col(index).alias("index"))))


def clean_choice(c: Column | str) -> Column:
    """Without bracketed notes, with single blanks."""
    x = F.regexp_replace(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", "")
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def completion_choices(df: DataFrame, split: str) -> DataFrame:
    """Context with a capitalised second part, cleaned endings, gold index; rows without a label go."""
    rows = df.where(F.length("label") > 0)
    query = clean_choice(F.concat("activity_label", F.lit(": "), "ctx_a", F.lit(" "), T.capitalize("ctx_b")))
    extra = F.struct(F.lit(split).alias("split"), F.transform("endings", clean_choice).alias("choices"))
    return rows.select(*_row(F.lit("completion"), messages(("user", query)), "nlp", F.col("label").cast("int").cast("string"), extra, style="model"))


def search_questions(df: DataFrame, prefix: str, split: str, index: str = "index") -> DataFrame:
    """question rows for retrieval tools: truth falls back to the golden answers, tools get nested arguments."""
    truth = F.coalesce("ground_truth", "golden_answers")
    source = F.concat(F.lit("search_"), "data_source")
    tools = F.struct(F.struct(F.struct(truth.alias("ground_truth"), F.col("question"), source.alias("data_source")).alias("create_kwargs")).alias("search"))
    extra = F.struct(F.lit(split).alias("split"), F.col(index).alias("index"), F.lit(True).alias("need_tools_kwargs"), F.col("question"), tools.alias("tools_kwargs"))
    return df.select(*_row(source, messages(("user", F.concat(F.lit(prefix), "question"))), "fact-reasoning", F.to_json(F.struct(truth.alias("target"))), extra))


def preference_to_sft(df: DataFrame) -> DataFrame:
    """prompt, chosen, rejected -> two rows prompt, response, preferred."""
    both = F.array(F.struct(F.col("chosen").alias("response"), F.lit(True).alias("preferred")), F.struct(F.col("rejected").alias("response"), F.lit(False).alias("preferred")))
    return df.select("prompt", F.inline(both))


def multiple_choice(df: DataFrame, key: str, question: str, gold: str, wrong: list[str], seed: int = 42) -> DataFrame:
    """Options in an order hashed from the key, with the gold option's letter."""
    options = F.array(F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:0"))).alias("h"), F.col(gold).alias("o"), F.lit(True).alias("g")), *[F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{i + 1}"))).alias("h"), F.col(w).alias("o"), F.lit(False).alias("g")) for i, w in enumerate(wrong)])
    out = df.withColumn("_o", F.array_sort(options))
    place = F.array_position(F.transform("_o", lambda x: x["g"]), True)
    letters = F.array_join(F.transform("_o", lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), x["o"])), "\n")
    return out.withColumns({"prompt": F.concat(F.col(question), F.lit("\n\n"), letters), "letter": F.char(F.lit(64) + place)}).drop("_o")


def add_tool_arguments(df: DataFrame, name: str, truth: Column | str) -> DataFrame:
    t = F.col(truth) if isinstance(truth, str) else truth
    return df.withColumn("extra_info", F.col("extra_info").withField("tools_kwargs", F.struct(F.struct(F.struct(t.alias("ground_truth")).alias("create_kwargs")).alias(name))))


def hoisted(df: DataFrame) -> DataFrame:
    """index of extra_info as a column, 0 if it is missing."""
    return df.withColumn("index", F.coalesce(F.col("extra_info.index"), F.lit(0)))


#: Bytes that a compressed blob of test cases may expand to.
CASE_BYTES = 64 << 20
#: Fixed names: opcodes of a serialised plain string; none of them calls or imports anything.
_TEXT_CODES = {"PROTO", "FRAME", "SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "MEMOIZE", "BINPUT", "LONG_BINPUT", "STOP"}


def _blob_text(blob: str | None, most: int) -> str | None:
    """The text of one blob; None if it is broken, larger than ``most`` bytes or anything but text."""
    if blob is None:
        return None
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(base64.b64decode(blob, validate=True), most)
        if stream.unconsumed_tail or not stream.eof:
            return None
        if raw[:1] != b"\x80":
            return raw.decode("utf-8")
        # A serialised string: its opcodes are read as data, nothing is loaded.
        found = [(code.name, value) for code, value, _ in pickletools.genops(raw)]
        texts = [value for name, value in found if name.endswith("BINUNICODE") or name == "BINUNICODE8"]
        return texts[0] if len(texts) == 1 and {name for name, _ in found} <= _TEXT_CODES else None
    except (ValueError, zlib.error, IndexError):
        return None


def unpacked_cases(blob: Column | str, most: int = CASE_BYTES) -> Column:
    """The text in a blob of base64 and zlib; null for nulls and for blobs that are broken or expand beyond ``most`` bytes.

    Blobs come and go in Arrow batches; expanding stops at the bound, so a small blob can't fill a worker's memory."""

    @arrow_udf("string")
    def unpack(blobs: pa.Array) -> pa.Array:
        return pa.array([_blob_text(b.as_py(), most) for b in blobs], pa.string())

    return unpack(F.col(blob) if isinstance(blob, str) else blob)


def packed_cases(text: Column | str) -> Column:
    """A text as a blob of base64 and zlib, that :func:`unpacked_cases` reads."""

    @arrow_udf("string")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else base64.b64encode(zlib.compress(t.encode("utf-8"))).decode("ascii") for t in texts.to_pylist()], pa.string())

    return pack(F.col(text) if isinstance(text, str) else text)


def merge_test_cases(public: Column | str, private: Column | str, name: Column | str | None = None) -> Column:
    """JSON of the inputs and outputs of two JSON lists of test cases, public ones first, and of the function's name if
    there is one.  Lists that can't be read count as empty; packed ones go through :func:`unpacked_cases` before."""
    kind = "array<struct<input:string,output:string>>"
    both = F.concat(*[F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, kind), F.array().cast(kind)) for c in (public, private)])
    fields = [F.transform(both, lambda t: t["input"]).alias("inputs"), F.transform(both, lambda t: t["output"]).alias("outputs")]
    if name is not None:
        fields.append((F.col(name) if isinstance(name, str) else name).alias("fn_name"))
    return F.to_json(F.struct(*fields))


def multiturn_loss_mask(messages_: Column | str, lengths: Column | str) -> Column:
    """Flat mask over the turns' token counts: assistant turns 1, all else 0; system may only come first."""
    m, n = (F.col(c) if isinstance(c, str) else c for c in (messages_, lengths))
    misplaced = F.exists(F.transform(m, lambda t, i: (t["role"] == "system") & (i > 0)), lambda x: x)
    unknown = F.exists(m, lambda t: ~t["role"].isin("system", "user", "assistant", "tool"))
    mask = F.flatten(F.zip_with(m, n, lambda t, k: F.array_repeat((t["role"] == "assistant").cast("int"), k)))
    return F.when(misplaced | unknown, F.raise_error(F.lit("invalid roles")).cast("array<int>")).otherwise(mask)
