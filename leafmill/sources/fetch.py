"""Documents behind http(s) addresses, staged as bytes: one row per address, a failure is a row.

Fetching is off unless asked for. Hosts that lead into a private network are refused, on every
redirect too, and a body beyond the ceiling is not read to its end.
"""

from __future__ import annotations

import ipaddress
import re
import socket
import urllib.request
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.budget import Budget
from leafmill.functions.text import direct_link
from leafmill.sources.base import ReadError

# Suffixes of media types.
SUFFIXES = {
    "application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt", "text/csv": ".csv", "text/markdown": ".md", "application/zip": ".zip", "application/epub+zip": ".epub", "message/rfc822": ".eml",
    "application/xml": ".xml", "text/xml": ".xml",
}
STAGED = "url string, name string, content binary, error string, hint string"
SECONDS = 30


def public_host(url: str) -> None:
    """Raise unless an address is http(s) and all that its host resolves to is public."""
    said = urlparse(url)
    if said.scheme not in ("http", "https") or not said.hostname:
        raise ReadError(f"{url!r} is no http(s) address", "give an http(s) address or a file")
    try:
        found = {x[4][0] for x in socket.getaddrinfo(said.hostname, said.port or 443)}
    except OSError:
        raise ReadError(f"{said.hostname} has no address", "check the spelling") from None
    if not all(ipaddress.ip_address(a.split("%")[0]).is_global for a in found):
        raise ReadError(f"{said.hostname} is not public", "bring the file as bytes")


def file_name(url: str, disposition: str = "", media_type: str = "") -> str:
    """A safe name: from the header, else the path, with a suffix by type if there is none."""
    said = re.search(r"""filename\*?=(?:UTF-8'')?"?([^";]+)""", disposition or "", re.I)
    name = unquote(said[1]) if said else unquote(urlparse(url).path.rsplit("/", 1)[-1])
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("._")[:120] or "download"
    return name if re.search(r"\.[A-Za-z0-9]+$", name) else name + SUFFIXES.get(media_type.split(";")[0].strip().lower(), "")


class _Checked(urllib.request.HTTPRedirectHandler):
    def __init__(self, allowed):
        self.allowed = allowed

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.allowed(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetched(url: str, most: int, allowed=public_host) -> tuple[str, bytes]:
    """(name, bytes) behind an address."""
    allowed(url)
    opener = urllib.request.build_opener(_Checked(allowed))
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": "leafmill"}), timeout=SECONDS) as answer:
            data = answer.read(most + 1)
            name = file_name(answer.geturl(), answer.headers.get("Content-Disposition", ""), answer.headers.get("Content-Type", ""))
    except ReadError:
        raise
    except (OSError, ValueError) as bad:
        raise ReadError(f"{url} can't be fetched: {bad}", "check the address, or bring the file") from None
    if len(data) > most:
        raise ReadError(f"the file is over {most} bytes", "split the file, or raise the source ceiling")
    return name, data


def fetch(urls: DataFrame, column: str = "url", budget: Budget = Budget(), allowed=public_host) -> DataFrame:
    """Addresses to (url, name, content, error, hint); share links are followed to the file."""
    most = budget.source_bytes

    def read(batches):
        for pdf in batches:
            for url, direct in zip(pdf["url"], pdf["direct"]):
                try:
                    name, data = fetched(direct, most, allowed)
                    row = (url, name, data, None, None)
                except Exception as bad:  # one dead address is a row that says so
                    row = (url, None, None, str(bad), getattr(bad, "hint", "check the address"))
                yield pd.DataFrame([row], columns=["url", "name", "content", "error", "hint"])

    named = urls.select(F.col(column).alias("url"), direct_link(F.col(column)).alias("direct"))
    return named.mapInPandas(read, STAGED)
