"""Answer extraction, normalisation and equality as column builders, with Arrow UDFs where braces must balance."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructType

from .text import strip


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The last match's group; null without a match."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group)), F.lit(-1))


# -- grade-school answers ------------------------------------------------------------------------------

_HASHES = r"#### (\-?[0-9\.\,]+)"
_NUMBER = r"(\-?[0-9\.\,]+)"


def gsm_truth(c: Column | str, strict: bool = False) -> Column:
    """First ``#### number`` without commas; null (or with ``strict`` an error) if there is none."""
    found = F.regexp_extract(_c(c), _HASHES, 1)
    missing = F.raise_error(F.lit("no answer after ####")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(found == "", missing).otherwise(F.replace(found, F.lit(","), F.lit("")))


def gsm_strict(c: Column | str) -> Column:
    """Last ``#### number`` without commas and dollar signs; null if there is none."""
    return F.regexp_replace(last_match(c, _HASHES), r"[,$]", "")


def gsm_flexible(c: Column | str) -> Column:
    """The last number-like token that is neither empty nor a lone dot; the first token if all are; null without any."""
    found = F.regexp_extract_all(_c(c), F.lit(_NUMBER), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: ~x.isin("", ".")), F.lit(-1)), F.try_element_at(found, F.lit(1)))


def gsm_score(c: Column | str, truth: Column | str, method: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    answer = {"strict": gsm_strict, "flexible": gsm_flexible}[method](c)
    return F.when(answer.isNull(), 0.0).when(answer == _c(truth), score).otherwise(format_score)


# -- boxed answers -------------------------------------------------------------------------------------


def boxed_spans(text: str | None, openers: tuple[str, ...] = ("\\boxed",)) -> list[tuple[int, int, str]]:
    """(start, end, content) of every balanced box in order, nested ones included, unclosed ones left out; one pass."""
    out, open_ = [], []  # open_: (start of the box or -1, start of the content)
    for m in re.finditer("|".join(re.escape(o) + r"\{" for o in openers) + r"|[{}]", text or ""):
        if m.group() != "}":
            open_.append((m.start() if len(m.group()) > 1 else -1, m.end()))
        elif open_:
            start, inner = open_.pop()
            if start >= 0:
                out.append((start, m.end(), text[inner : m.start()]))
    return sorted(out)


def last_boxed(text: str | None) -> str | None:
    """The last boxed expression with its command: the space form up to a dollar sign comes first, then boxed, then fbox."""
    if text is None:
        return None
    if "\\boxed " in text:
        return "\\boxed " + text.split("\\boxed ")[-1].split("$")[0]
    at = text.rfind("\\boxed")
    if at < 0:
        at = text.rfind("\\fbox")
    if at < 0:
        return None
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return text[at : m.end()]
    return None


def remove_boxed(boxed: str | None) -> str | None:
    if boxed is None:
        return None
    if boxed.startswith("\\boxed "):
        return boxed[7:]
    for opener in ("\\boxed{", "\\fbox{"):
        if boxed.startswith(opener) and boxed.endswith("}"):
            return boxed[len(opener) : -1]
    return None


@F.pandas_udf(StringType())
def last_boxed_content(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: remove_boxed(last_boxed(t)), na_action="ignore")


@F.pandas_udf(ArrayType(StructType().add("start", "integer").add("end", "integer").add("content", "string")))
def all_boxed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "content": c} for a, b, c in boxed_spans(t)])


# -- competition mathematics ---------------------------------------------------------------------------

# Substitutions and removals in the order in which they apply.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED_EXPRESSIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}",
    r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def minerva_normalize(c: Column | str) -> Column:
    """Text after the last equals sign, through the fixed substitutions, LaTeX unwrapping and number clean-up."""
    x = F.element_at(F.split(_c(c), "="), -1)
    x = replaced(x, SUBSTITUTIONS + [(e, "") for e in REMOVED_EXPRESSIONS])
    for pattern, to in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}")):
        x = F.regexp_replace(x, pattern, to)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return strip(F.when(F.rlike(bare, F.lit(r"^[0-9]+$")), bare).otherwise(x))


def minerva_answer(c: Column | str) -> Column:
    """The last ``Answer: ...`` line, else ``[INVALID]``."""
    return F.coalesce(last_match(c, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))


def dapo_score(response: Column | str, truth: Column | str) -> Column:
    """struct<score, acc, pred> from the last 300 characters: 1 or -1."""
    pred = minerva_normalize(minerva_answer(F.right(_c(response), F.lit(300))))
    acc = F.coalesce(pred == minerva_normalize(truth), F.lit(False))
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def math_strip(text: str | None) -> str | None:
    """The MATH normal form.  Rewrites apply in this order; a malformed fraction leaves the text as it is."""
    if text is None:
        return None
    # Literal rewrites, in order.
    for a, b in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        text = text.replace(a, b)
    units = text.split("\\text{ ")
    if len(units) > 2:
        raise ValueError("two units")
    text = units[0].replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not text:
        return text
    if text[0] == ".":
        text = "0" + text
    sides = text.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        text = sides[1]
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text, flags=re.DOTALL).replace(" ", "")
    if not re.search(r"\\frac(?!\{)(?:.?(?=\\frac)|.?$)", text, flags=re.DOTALL):
        text = re.sub(r"\\frac(?!\{)(.)(?:(\{)|(.))", lambda m: f"\\frac{{{m[1]}}}" + (m[2] or f"{{{m[3]}}}"), text, flags=re.DOTALL)
    if text == "0.5":
        return "\\frac{1}{2}"
    return re.sub(r"^(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))$", lambda m: text if "-0" in (m[1], m[2]) else f"\\frac{{{m[1]}}}{{{m[2]}}}", text)


def math_equal(a: str | None, b: str | None) -> bool:
    """Equality of the normal forms; two nulls are equal; texts that can't be normalised are compared as they are."""
    if a is None or b is None:
        return a is None and b is None
    try:
        return math_strip(a) == math_strip(b)
    except (ValueError, IndexError):
        return a == b


@F.pandas_udf(StringType())
def math_normal_form(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return math_strip(t)
        except (ValueError, IndexError):
            return t

    return texts.map(one, na_action="ignore")


@F.pandas_udf(DoubleType())
def math_score(responses: pd.Series, truths: pd.Series) -> pd.Series:
    """1 if the last boxed answer equals the truth, else 0; a response that can't be read is 0."""
    out = []
    for r, t in zip(responses, truths, strict=True):
        try:
            answer = remove_boxed(last_boxed(r))
            out.append(float(answer is not None and math_equal(answer, t)))
        except Exception:  # a scorer never fails its batch
            out.append(0.0)
    return pd.Series(out)


def parse_number(text: str) -> Fraction | None:
    """Integers, decimals, percentages, a/b and simple LaTeX fractions as exact numbers."""
    t = text.strip().replace(",", "").replace("\\%", "%").replace("$", "").replace(" ", "")
    percent = t.endswith("%")
    t = t.rstrip("%")
    m = re.fullmatch(r"(-?)\\[dt]?frac\{(-?\d+)\}\{(-?\d+)\}", t) or re.fullmatch(r"(-?)(\d+)/(\d+)", t)
    try:
        value = Fraction(int(m[2]), int(m[3])) * (-1 if m[1] else 1) if m else Fraction(t)
    except (ValueError, ZeroDivisionError):
        return None
    return value / 100 if percent else value


def grade(answer: str | None, truth: str | None, rel: float = 1e-4) -> bool:
    """Tiers without a symbolic engine: normal forms, exact rationals, decimals within ``rel`` (percent tolerant),
    then element by element in tuples, sets and intervals whose brackets agree.  Nothing is evaluated."""
    if answer is None or truth is None:
        return False
    if math_equal(answer, truth):
        return True
    a, b = answer.strip(), truth.strip()
    if len(a) > 1 and len(b) > 1 and a[0] in "([{" and a[-1] in ")]}" and "," in a and "," in b:
        left, right = a[1:-1].split(","), b[1:-1].split(",")
        return a[0] == b[0] and a[-1] == b[-1] and len(left) == len(right) and all(grade(x, y, rel) for x, y in zip(left, right, strict=True))
    x, y = parse_number(a), parse_number(b)
    if x is None or y is None:
        return False
    return any(x == z or abs(x - z) <= rel * max(abs(x), abs(z)) and (x.denominator > 1 or z.denominator > 1) for z in (y, y / 100, y * 100))


@F.pandas_udf(BooleanType())
def grade_udf(answers: pd.Series, truths: pd.Series) -> pd.Series:
    return pd.Series([grade(a, t) for a, t in zip(answers, truths, strict=True)], dtype=object)


# -- question answering, tags, letters, penalties --------------------------------------------------------


def qa_normalize(c: Column | str) -> Column:
    """Lower case, without ASCII punctuation and the articles, white space collapsed."""
    x = F.regexp_replace(F.lower(_c(c)), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def exact_match(pred: Column | str, golds: Column | str, contained: bool = False) -> Column:
    """Whether the prediction equals (or contains) one of the golds, normalised."""
    p = qa_normalize(pred)
    return F.exists(_c(golds), lambda g: F.contains(p, qa_normalize(g)) if contained else qa_normalize(g) == p)


def answer_tag(c: Column | str) -> Column:
    """Content of the last answer tag pair, stripped; null without one."""
    return strip(last_match(c, r"(?s)<answer>(.*?)</answer>"))


def search_score(response: Column | str, golds: Column | str, score: float = 1.0, format_score: float = 0.0, contained: bool = False) -> Column:
    """0 without an answer tag; a response with more than ten opening or closing tags is worth a quarter."""
    answer = answer_tag(response)
    spam = (F.regexp_count(_c(response), F.lit("<answer>")) > 10) | (F.regexp_count(_c(response), F.lit("</answer>")) > 10)
    return F.when(answer.isNull(), 0.0).when(exact_match(answer, golds, contained), F.when(spam, score / 4).otherwise(score)).otherwise(format_score)


def choice_letter(c: Column | str) -> Column:
    found = F.regexp_extract(_c(c), r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when(found != "", found)


def think_format(c: Column | str) -> Column:
    return F.rlike(_c(c), F.lit(r"(?s)^<think>\n.*?\n</think>"))


def geo_format(c: Column | str) -> Column:
    return F.rlike(_c(c), F.lit(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"))


def overlong_penalty(length: Column | str, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to limit - buffer, then falling linearly by factor over the buffer."""
    return F.least(-(_c(length) - F.lit(limit - buffer)) / F.lit(float(buffer)) * F.lit(factor), F.lit(0.0))


def strip_suffix(c: Column | str, suffix: str) -> Column:
    return F.when(F.endswith(_c(c), F.lit(suffix)), F.left(_c(c), F.length(_c(c)) - len(suffix))).otherwise(_c(c))


def code_block(c: Column | str) -> Column:
    """Content of the last fenced python block, else of the last fenced block, else the text."""
    return F.coalesce(last_match(c, r"(?s)```python\n(.*?)```"), last_match(c, r"(?s)```\n?(.*?)```"), _c(c))


def same_output(expected: Column | str, got: Column | str) -> Column:
    """Equality of program outputs, line by line with line ends and outer white space ignored."""
    lines = lambda c: F.array_join(F.transform(F.split(strip(c), "\n"), lambda x: strip(x)), "\n")
    return lines(expected) == lines(got)
