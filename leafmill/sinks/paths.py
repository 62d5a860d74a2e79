"""Where an answer may be written: below one folder, if the engine has one."""

from __future__ import annotations

import posixpath
import re

from leafmill.sources.base import ReadError


def output_path(wanted: str, source: str, suffix: str, root: str = "") -> str:
    """The path for an output.

    Without a wish, the source's name with _out and the suffix. A relative path is below the
    root. With a root, a path that leads out of it is refused, by name alone and before anything
    is looked for.
    """
    if not wanted.strip():
        stem = re.sub(r"\.[^./]*$", "", source.rsplit("/", 1)[-1].replace("::", "_"))
        if not stem:
            raise ReadError("no output path is given", "give out")
        wanted = f"{stem}_out{suffix}"
    if not root:
        return wanted
    absolute = re.match(r"[A-Za-z][\w+.-]*:|/", wanted)
    path = wanted if absolute else f"{root.rstrip('/')}/{wanted}"
    scheme, name = re.match(r"([A-Za-z][\w+.-]*:(?://[^/]*)?)?(.*)", path, re.S).groups()
    top_scheme, top = re.match(r"([A-Za-z][\w+.-]*:(?://[^/]*)?)?(.*)", root, re.S).groups()
    plain, top = posixpath.normpath(name), posixpath.normpath(top)
    local = {None, "", "file:", "file://"}
    same = scheme == top_scheme or {scheme, top_scheme} <= local
    if not same or not (plain == top or plain.startswith(top.rstrip("/") + "/")):
        raise ReadError(f"{wanted!r} lies outside the output folder", f"give a path below {root}, or a relative one")
    return (scheme or "") + plain
