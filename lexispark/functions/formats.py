"""Texts that answers are shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.text import collapse, safe_label

RULE = "\n----------\n"
BREAK = "\n\n---\n\n"


def truncate(text: Column, most: int = 16_000) -> Column:
    """A text cut to size, with a notice."""
    return F.when(
        F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[Result truncated]"))
    ).otherwise(text)


def library_block(
    title: Column, ident: Column, description: Column, snippets: Column, reputation: Column,
    versions: Column | None = None
) -> Column:
    """A library as lines; counts below 0 and lists without versions are left out."""
    lines = [
        F.concat(F.lit("- Title: "), title),
        F.concat(F.lit("- Library ID: "), ident),
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("- Description: "), description)),
        F.when(snippets >= 0, F.concat(F.lit("- Code Snippets: "), snippets.cast("string"))),
        F.concat(F.lit("- Source Reputation: "), reputation),
    ]
    if versions is not None:
        lines.append(F.when(F.size(versions) > 0, F.concat(F.lit("- Versions: "), F.array_join(versions, ", "))))
    return F.concat_ws("\n", *lines)


def code_snippet(title: Column, description: Column, codes: Column) -> Column:
    """A code snippet: heading, description, fenced codes (structs of language and code)."""
    fenced = F.transform(
        codes,
        lambda c: F.concat(F.lit("```"), F.coalesce(c["language"], F.lit("")), F.lit("\n"), c["code"], F.lit("\n```"))
    )
    return F.concat_ws(
        "\n\n", F.concat(F.lit("### "), title), F.when(F.coalesce(description, F.lit("")) != "", description),
        F.array_join(fenced, "\n\n")
    )


def info_snippet(breadcrumb: Column, content: Column) -> Column:
    return F.concat_ws(
        "\n\n", F.concat(F.lit("### "), F.coalesce(F.nullif(breadcrumb, F.lit("")), F.lit("Documentation"))), content
    )


def provenance(ident: Column, commit: Column, n_rules: Column) -> Column:
    """What an answer rests on; a project's rules are counted, never shown."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Library: "), ident), F.concat(F.lit("Commit: "), commit),
        F.when(n_rules > 0, F.concat(F.lit("Project rules omitted: "), n_rules.cast("string")))
    )


def fixed4(value: Column) -> Column:
    return F.format_string("%.4f", value.cast("double"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def match_block(n: Column, title: Column, section: Column, key: Column, url: Column, path: Column, score: Column, paths: Column, content: Column) -> Column:
    """A search result as lines: its place and titles, its key, source and path, its relevance, the start of its text."""
    line = F.trim(collapse(content))
    shown = F.substring(line, 1, 360)
    return F.concat_ws(
        "\n", F.concat(F.lit("## "), n.cast("string"), F.lit(". "), safe_label(title), F.lit(" — "), safe_label(section)),
        F.concat(F.lit("Result key: "), key), F.concat(F.lit("Source: "), url), F.concat(F.lit("Path: "), safe_label(path)),
        F.concat(F.lit("Relevance: "), fixed4(score), F.lit(" ("), paths.cast("string"), F.lit(" retrieval paths)")), F.lit(""),
        F.concat(
            F.lit("Untrusted reference preview: "), shown, F.when(F.length(content) > F.length(shown), "…").otherwise("")
        )
    )


def grep_block(key: Column, title: Column, section: Column, url: Column, snippet: Column) -> Column:
    """A literal match as lines: its key and titles, its source, the text around it."""
    return F.concat_ws(
        "\n", F.concat(F.lit("- Result "), key, F.lit(": "), safe_label(title), F.lit(" — "), safe_label(section)),
        F.concat(F.lit("  "), url), F.concat(F.lit("  Untrusted reference match: …"), snippet, F.lit("…"))
    )
