"""Query text for the vector search and prompt text for callers who bring
their own model (the model call itself is the caller's ``mapInPandas``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutline.functions.text import trim_text

_INDENT = "\n        "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _csv(arr) -> Column:
    return F.array_join(F.coalesce(_c(arr), F.array().cast("array<string>")), ", ")


def search_text(resume, roles, industries, locations, mode: str = "effective") -> Column:
    """Résumé and preferences as one labelled block (four lines, indented as
    in the reference's template, outer whitespace stripped).

    ``mode='reference'`` leaves role and locations blank: the reference reads
    keys that submitted preferences never contain."""
    if mode == "reference":
        role, locs = F.lit(""), F.lit("")
    elif mode == "effective":
        role, locs = _csv(roles), _csv(locations)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # The labels of the block.
    block = F.concat(F.lit("Resume: "), F.coalesce(_c(resume), F.lit("")),
                     F.lit(_INDENT + "Desired Role: "), role,
                     F.lit(_INDENT + "Preferred Industries: "), _csv(industries),
                     F.lit(_INDENT + "Preferred Locations: "), locs)
    return trim_text(block)


def py_list(arr) -> Column:
    """Python-style list text: ['a', 'b']."""
    a = F.coalesce(_c(arr), F.array().cast("array<string>"))
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


def eval_prompt(startup_info, resume, roles, industries, locations, stages) -> Column:
    """Evaluation request for a caller-supplied model: the company text, the
    résumé, the four preference lists and the rubric with its weights."""
    return F.format_string(
        "Evaluate this candidate for this startup.\n\nSTARTUP:\n%s\n\nRESUME:\n%s\n\n"
        "PREFERENCES:\nRoles: %s\nIndustries: %s\nLocations: %s\nStages: %s\n\n"
        "Score industry (35%%), technical skills (25%%), experience level (25%%) and growth stage "
        "(15%%) between 0 and 1, and answer with one JSON object holding company_name, "
        "company_description, industry_score, technical_score, experience_score, growth_score, "
        "final_score and reasoning.",
        _c(startup_info), _c(resume), py_list(roles), py_list(industries), py_list(locations),
        py_list(stages))
