"""Text column functions (projections and filters of the reference's
loaders and formatters). All are Column -> Column, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .det import u01

# Characters Python's str.strip() removes: \s and the Unicode separators,
# plus the C0 separators 0x1C-0x1F, vertical tab and NEL, which Java's \s
# and \p{Z} leave alone.
_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
STRIP_PATTERN = f"^{_WS}+|{_WS}+$"
LEAD_PATTERN = f"^{_WS}+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove Unicode whitespace at both ends (Python ``str.strip``).

    Linear time: a trailing ``[..]+$`` pattern backtracks quadratically over
    long whitespace runs inside a text, so the trailing side is stripped as
    the leading side of the reversed string.
    """
    c = _c(col)
    lead = F.regexp_replace(c, LEAD_PATTERN, "")
    both = F.reverse(F.regexp_replace(F.reverse(lead), LEAD_PATTERN, ""))
    # most texts have no outer whitespace: test the two edge characters first
    edge = F.substring(c, 1, 1).rlike(_WS) | F.substring(c, -1, 1).rlike(_WS)
    return F.when(edge, both).otherwise(c)


def drop_blank(col) -> Column:
    """Predicate: keep rows whose text is not null and not blank."""
    return F.length(strip(F.coalesce(_c(col), F.lit("")))) > 0


def id_text(col) -> Column:
    """Any id as stripped text; missing ids become ''."""
    return F.coalesce(strip(_c(col).cast("string")), F.lit(""))


def combine_title_text(title, text, sep: str = "\n") -> Column:
    """title + sep + text, title alone or text alone, then stripped."""
    t = F.nullif(strip(F.coalesce(_c(title), F.lit(""))), F.lit(""))
    x = F.nullif(strip(F.coalesce(_c(text), F.lit(""))), F.lit(""))
    # both parts are stripped and blank parts are null (skipped by concat_ws),
    # so the joined text has no outer whitespace
    return F.concat_ws(sep, t, x)


# The six task instructions prefixed to queries. They must be
# identical to the ones the embedding models were trained with.
TASK_INSTRUCTIONS = {
    "FactCheck": "Given the claim, retrieve most relevant document that supports or refutes the claim",
    "NLI": "Given the premise, retrieve most relevant hypothesis that is entailed by the premise",
    "QA": "Given the question, retrieve most relevant passage that best answers the question",
    "QAdoc": "Given the question, retrieve the most relevant document that answers the question",
    "STS": "Given the sentence, retrieve the sentence with the same meaning",
    "Twitter": "Given the user query, retrieve the most relevant Twitter text that meets the request",
}

# Suites whose queries always use one task instruction.
SUITE_TASK = {"trec": "QA", "climate": "FactCheck", "biosses": "STS"}


def suite_prefix(query, suite: str, task=None) -> Column:
    """Queries of a single-file suite get that suite's instruction, those of
    the main suite the instruction of their task."""
    fixed = SUITE_TASK.get(suite)
    return task_prefix(query, F.lit(fixed) if fixed else task)


def task_prefix_col(task) -> Column:
    """Instruction for a task column; unknown tasks give ''.

    Built as a literal map: six entries, so it is a constant folded into the
    projection rather than a join.
    """
    m = F.create_map(*[F.lit(x) for kv in TASK_INSTRUCTIONS.items() for x in kv])
    return F.coalesce(m[_c(task)], F.lit(""))


def task_prefix(query, task) -> Column:
    """'<instruction>: <stripped query>'."""
    return F.concat(task_prefix_col(task), F.lit(": "), strip(_c(query)))


def format_instruction(fmt: str, instruction, text) -> Column:
    """Two-slot format ``fmt.format(instruction, text)`` with ``\\n`` escapes
    expanded; a null instruction leaves the text unformatted."""
    f = fmt.replace("\\n", "\n").replace("%", "%%").replace("{}", "%s")
    ins = _c(instruction)
    return F.when(ins.isNull(), _c(text)).otherwise(F.format_string(f, ins, _c(text)))


def chunk_shuffle(text, ratio: float, seed, *keys) -> Column:
    """Cut texts longer than 100 characters, with chance ``ratio``, in pieces
    of ``len div 3 + 1``; shuffle the pieces and join them with a space.

    The chance and the piece order are md5 uniforms over (seed, keys..), so
    the result is the same for any partitioning.
    """
    t = _c(text)
    n = F.length(t)
    size = F.floor(n / 3).cast("int") + 1
    pieces = F.ceil(n / size).cast("int")
    shuffled = F.array_join(
        F.transform(
            F.array_sort(F.transform(
                F.sequence(F.lit(0), pieces - 1),
                lambda i: F.struct(u01(seed, *keys, F.lit("chunk"), i).alias("u"),
                                   i.alias("i"),
                                   F.substring(t, i * size + 1, size).alias("s")))),
            lambda s: s["s"]),
        " ")
    hit = (n > 100) & (u01(seed, *keys, F.lit("shuffle")) < F.lit(ratio))
    return F.when(F.lit(ratio > 0) & hit, shuffled).otherwise(t)


def parse_grade(label) -> Column:
    """Text grade to DOUBLE; unparsable gives 0.0."""
    return F.coalesce(_c(label).try_cast("double"), F.lit(0.0))


def has_keys(*keys) -> Column:
    """Keep judgements whose query and document keys are not blank."""
    out = drop_blank(_c(keys[0]).cast("string"))
    for k in keys[1:]:
        out = out & drop_blank(_c(k).cast("string"))
    return out
