"""Clones of repositories: shallow, sparse and with nothing of the machine's own settings."""

from __future__ import annotations

import os
import subprocess

from lexispark.functions.paths import EXTENSIONS

#: Files that a clone needs besides documentation: settings and descriptions.
ALSO = ["*.json", "pyproject.toml", "Cargo.toml"]


def sparse_patterns() -> list[str]:
    """What is checked out: documentation of any kind in any folder, and settings at the root."""
    return [f"*{e}" for e in EXTENSIONS] + [f"/{p}" for p in ALSO]


def clone(url: str, to: str, ref: str | None = None, timeout_s: float = 600.0) -> str:
    """Clone a repository's documentation into a new folder; returns the commit.

    One commit is fetched, without the contents of what isn't checked out. Hooks, prompts, credentials and settings of
    the user and the system take no part; a failure leaves no folder.
    """
    env = {
        "PATH": os.environ.get("PATH", ""), "HOME": to, "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull,
        "GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "true", "LC_ALL": "C"
    }
    safe = ["-c", "core.hooksPath=/dev/null", "-c", "protocol.ext.allow=never", "-c", "core.symlinks=false"]

    def git(*args: str) -> str:
        done = subprocess.run(
            ["git", *safe, *args], env=env, capture_output=True, text=True, timeout=timeout_s, check=True
        )
        return done.stdout.strip()

    if os.path.exists(to):
        raise FileExistsError(to)
    try:
        wanted = ["--branch", ref] if ref else []
        git("clone", "--depth", "1", "--filter=blob:none", "--no-checkout", "--no-tags", *wanted, "--", url, to)
        git("-C", to, "sparse-checkout", "set", "--no-cone", *sparse_patterns())
        git("-C", to, "checkout")
        return git("-C", to, "rev-parse", "HEAD")
    except Exception:
        import shutil

        shutil.rmtree(to, ignore_errors=True)
        raise
