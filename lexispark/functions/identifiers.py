"""Library ids, repository addresses, keys, urls, versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.text import SPACES

PART = r"[A-Za-z0-9_.-]+"
VERSION = r"[A-Za-z0-9_.+/-]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, rf"\A{SPACES}|{SPACES}\z", "")


def parse_library_id(value: Column) -> Column:
    """A struct of id, owner, repo, version and repository_url; null if the value is no library id."""
    part = lambda p: p.rlike(rf"\A{PART}\z") & ~p.isin(".", "..")

    def made(x: Column) -> Column:
        owner, repo, rest = x["owner"], x["repo"], x["rest"]
        good = part(owner) & part(repo) & ((rest == "") | (rest.rlike(rf"\A{VERSION}\z") & ~F.contains(rest, F.lit(".."))))
        version = F.when(rest != "", rest)
        name = F.concat(owner, F.lit("/"), repo)
        ident = F.concat(F.lit("/"), name, F.coalesce(F.concat(F.lit("/"), version), F.lit("")))
        url = F.concat(F.lit("https://github.com/"), name, F.lit(".git"))
        return F.when(
            good,
            F.struct(
                ident.alias("id"), owner.alias("owner"), repo.alias("repo"), version.alias("version"),
                url.alias("repository_url")
            )
        )

    split = lambda b: F.struct(
        F.split_part(b, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(b, F.lit("/"), F.lit(2)).alias("repo"),
        F.regexp_extract(b, r"(?s)\A[^/]*/[^/]*/(.*)\z", 1).alias("rest")
    )
    return bind(bind(F.regexp_replace(trimmed(value), r"\A/+|/+\z", ""), split), made)


def parse_repository(value: Column) -> Column:
    """The library of a short name or of an https, ssh, git or git+ address of a repository on github.com; else null."""
    host = r"^(?i:https://github\.com)(?::443)?"

    def name(text: Column) -> Column:
        url = F.regexp_replace(text, "^git[+]", "")
        for old in (r"(?i)^git@github\.com:", r"(?i)^ssh://git@github\.com/", r"(?i)^git://github\.com/"):
            url = F.regexp_replace(url, old, "https://github.com/")
        return F.when(
            text.rlike(rf"\A/?{PART}/{PART}\z"), F.regexp_replace(text, r"(?i)\.git\z", "")
        ).otherwise(bind(url, at_host))

    def at_host(url: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(url, rf"{host}(/[^?#]*)?", 1), r"\A/+|/+\z", "")
        return F.when(
            url.rlike(rf"{host}([/?#]|\z)"),
            bind(F.regexp_replace(path, r"(?i)\.git\z", ""), lambda p: F.when(p.rlike(r"\A[^/]+/[^/]+\z"), p))
        )

    return parse_library_id(bind(trimmed(value), name))


def storage_key(ident: Column) -> Column:
    return F.sha2(F.lower(ident), 256)


def encode_component(part: Column) -> Column:
    """Percent-encoding of a path segment; letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def source_url(repository_url: Column, commit: Column, path: Column) -> Column:
    """The address of a file at a commit."""
    base = F.regexp_replace(repository_url, r"\.git$", "")
    return F.concat(
        base, F.lit("/blob/"), commit, F.lit("/"), F.array_join(F.transform(F.split(path, "/"), encode_component), "/")
    )


def result_key(commit: Column, chunk_id: Column) -> Column:
    return F.concat(commit, F.lit(":"), chunk_id.cast("string"))


def parse_result_key(key: Column, commit: Column) -> Column:
    """(chunk_id, state) of a result key: state is ok, stale (another commit) or invalid; a plain number is ok."""
    pattern = r"\A(?i)([0-9a-f]{40}):([1-9][0-9]*)\z"
    sha, number = F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2)
    plain = key.rlike(r"\A[1-9][0-9]*\z")
    state = F.when(
        plain | ((sha != "") & (F.lower(sha) == F.lower(commit))), "ok"
    ).when(sha != "", "stale").otherwise("invalid")
    return F.struct(
        F.when(state == "ok", F.when(plain, key).otherwise(number).try_cast("bigint")).alias("chunk_id"),
        state.alias("state")
    )


def version_numbers(version: Column) -> Column:
    """The dotted numbers of a version without what follows a hyphen; what is no number is 0."""
    return F.transform(
        F.split(F.split_part(version, F.lit("-"), F.lit(1)), r"\."),
        lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0))
    )


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a missing number is 0."""
    pairs = F.zip_with(
        version_numbers(a), version_numbers(b), lambda x,
        y: F.sign(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int")
    )
    return F.coalesce(F.get(F.filter(pairs, lambda s: s != 0), F.lit(0)), F.lit(0))


def canonical_url(url: Column, keep_query: bool = True, keep_fragment: bool = False) -> Column:
    """The url without its fragment and, if asked, without its query."""
    out = url if keep_fragment else F.regexp_replace(url, "#.*$", "")
    return out if keep_query else F.regexp_replace(out, r"\?[^#]*", "")


def recover_library_id(value: Column) -> Column:
    """A library id that a shell has turned into a Windows path, put right; other values as they are."""
    found = F.regexp_extract(F.translate(value, "\\", "/"), rf"^[A-Za-z]:/.*?/Git(/{PART}/{PART}(?:/.*)?)$", 1)
    return F.when(found != "", found).otherwise(value)


def tree_address(url: Column) -> Column:
    """Owner, repo, branch and path of a github.com tree or blob address; null for others."""
    pattern = rf"^https://github\.com/({PART})/({PART})/(?:tree|blob)/([^/?#]+)(?:/([^?#]*))?$"
    names = ("owner", "repo", "branch", "path")
    return F.when(
        url.rlike(pattern), F.struct(*[F.regexp_extract(url, pattern, i + 1).alias(n) for i, n in enumerate(names)])
    )


def parse_skill_input(value: Column) -> Column:
    """What a skill argument names: (type, owner, repo, branch, path) of a github.com tree address anywhere in it (type
    url), or of owner/repo with or without a leading slash (type repo, no branch or path); null for others."""
    address = r"(?:https?://)?github\.com/([^/]+)/([^/]+)/tree/([^/]+)/([^\r\n]+)"
    short = r"\A/?([^/]+)/([^/]+)\z"
    part = lambda pattern, k: F.regexp_extract(value, pattern, k)
    none = F.lit(None).cast("string")
    row = lambda kind, *parts: F.struct(
        F.lit(kind).alias("type"),
        *[p.alias(n) for p, n in zip(parts, ("owner", "repo", "branch", "path"), strict=True)]
    )
    return F.when(value.rlike(address), row("url", *[part(address, k) for k in (1, 2, 3, 4)])).when(
        value.rlike(short), row("repo", part(short, 1), part(short, 2), none, none)
    )


def safe_skill_name(name: Column) -> Column:
    """Whether a name can be a folder's: no separators, no leading dot, not empty, at most 255 characters."""
    return name.rlike(r"\A[A-Za-z0-9_-][A-Za-z0-9_. -]*\z") & ~F.contains(name, F.lit("..")) & (F.length(name) <= 255)


def front_matter(text: Column) -> Column:
    """Name and description of a front matter; a folded description is joined with spaces."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda name: F.trim(
        F.regexp_replace(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1), "^[\"']|[\"']$", "")
    )
    folded = F.regexp_extract(head, r"(?m)^description:[ \t]*[>|][+-]?[ \t]*((?:\r?\n[ \t]+[^\r\n]*)+)", 1)
    own = field("description")
    return F.struct(
        F.nullif(field("name"), F.lit("")).alias("name"),
        F.nullif(
            F.when(own.rlike(r"^[>|][+-]?$"), F.trim(F.regexp_replace(folded, r"\s+", " "))).otherwise(own), F.lit("")
        ).alias("description")
    )


# First parts of ids that are no repositories.
OTHER_KINDS = ["websites", "packages", "npm", "docs", "libraries", "llmstxt"]


def is_repository_id(ident: Column) -> Column:
    """Whether an id of two parts names a repository and not another kind of source."""
    parts = F.split(F.regexp_replace(ident, "^/", ""), "/")
    return (F.size(parts) == 2) & ~F.lower(parts[0]).isin(OTHER_KINDS)
