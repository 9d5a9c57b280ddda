"""Prompt rendering: templates are data, rendered with JVM string functions.

A template is a Python format string with named fields; it is split once on
the driver and becomes a single ``concat`` of literals and columns, so
rendering runs inside generated code on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Markers around code in our prompts; answers are expected as one fenced block.
CODE_OPEN = "<<<CODE\n"
CODE_CLOSE = "\nCODE>>>"

# Our own wording for the seven tasks: (system prompt, user prompt).
TEMPLATES: dict[str, tuple[str, str]] = {
    "analyze": (
        "You review source files and explain their structure and risks.",
        "Explain what this file does and point out problems.\nPath: {path}\n" + CODE_OPEN + "{code}" + CODE_CLOSE,
    ),
    "snippet": (
        "You rewrite one selected piece of a source file and nothing else.",
        "Rewrite the selected lines.\nPath: {path}\nKind of change: {kind}\n"
        "Overall guidance: {global_instruction}\nNote for this selection: {instruction}\n"
        "Keep behaviour unless the kind is bugfix. Add no new functions or classes. "
        "Answer with the rewritten lines only.\n" + CODE_OPEN + "{code}" + CODE_CLOSE,
    ),
    "dead_code": (
        "You rewrite source files carefully. Answer with the complete file inside one fenced code block.",
        "Remove dead code from the file below: imports, variables, functions and classes that nothing uses.\n"
        "Keep its behaviour and public interface.\nPath: {path}\n" + CODE_OPEN + "{code}" + CODE_CLOSE
        + "\nAnswer with the whole updated file only.",
    ),
    "simplify": (
        "You rewrite source files carefully. Answer with the complete file inside one fenced code block.",
        "Simplify the file below: clearer names, less repetition, idiomatic constructs, same behaviour.\n"
        "Path: {path}\n" + CODE_OPEN + "{code}" + CODE_CLOSE + "\nAnswer with the whole updated file only.",
    ),
    "dependencies": (
        "You audit dependency declarations. Answer with one JSON object: "
        '{{"summary": str, "issues": [{{"type", "file", "detail", "suggestion"}}], "notes": str}}.',
        "Files of one project follow. Decide which declare dependencies and report problems.\n{files_block}",
    ),
    "apply_issues": (
        "You edit one dependency file and keep its format. Answer with the full new file only.",
        "Path: {path}\nCurrent content:\n" + CODE_OPEN + "{code}" + CODE_CLOSE + "\nChanges to apply:\n{issues}",
    ),
    "convert": (
        "You translate projects between languages file by file. Answer with one JSON object: "
        '{{"files": [{{"path", "content"}}], "notes": str}}.',
        "Translate from {src_lang} to {tgt_lang}.\nTarget stack: {target_stack_desc}\n"
        "Summary: {summary}\nFiles:\n{files_block}",
    ),
}

# Fields that take a default when empty or missing.
NA_FIELDS = ("instruction", "global_instruction")
NO_SUMMARY = "(no summary provided)"


def _field(name: str, columns: dict[str, str]) -> F.Column:
    c = F.col(columns.get(name, name))
    if name in NA_FIELDS:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    if name == "summary":
        return F.coalesce(c, F.lit(NO_SUMMARY))
    return F.coalesce(c.cast("string"), F.lit(""))


def render(template: str, columns: dict[str, str] | None = None) -> F.Column:
    """One template as a ``concat`` of literals and (defaulted) columns."""
    columns = columns or {}
    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(_field(name, columns))
    return F.concat(*parts) if parts else F.lit("")


def render_prompts(df: DataFrame, task: str, templates=None, columns: dict[str, str] | None = None) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` for ``task``."""
    templates = templates or TEMPLATES
    if task not in templates:
        raise ValueError(f"unknown task {task!r}")
    system, user = templates[task]
    return df.withColumn("system_prompt", render(system, columns)).withColumn("user_prompt", render(user, columns))
