"""Identity of the file a URL leads to: one spelling for all equivalent ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that visitor tracking and sessions leave behind.
TRACKING = frozenset("gclid gclsrc dclid gbraid wbraid fbclid msclkid yclid twclid igshid mc_cid mc_eid _ga _gl _hsenc _hsmi mkt_tok phpsessid jsessionid aspsessionid sessionid session_id sid cfid cftoken".split())
TRACKING_PREFIXES = ("utm_", "aspsessionid")

_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
_SESSION = re.compile(r";(?:jsessionid|phpsessid|sid)=[^/?#;&]*", re.I)
_ODD = re.compile(r"%(?![0-9A-Fa-f]{2})|[^!#-;=?-\[\]_a-z~]", re.S)
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _escapes(text: str) -> str:
    """Escapes in one form: unreserved characters plain, all else that needs it as upper-case escapes."""
    if _ODD.search(text):
        text = _ODD.sub(lambda m: "%25" if m[0] == "%" else "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)
    if "%" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(b) if (b := int(m[1], 16)) in _UNRESERVED else m[0].upper(), text)


def _path(text: str) -> str:
    kept: list[str] = []
    segments = _escapes(text).split("/")
    for s in segments:
        if s == "..":
            kept = kept[:-1]
        elif s not in ("", "."):
            kept.append(s)
    closed = segments[-1] in ("", ".", "..") and kept
    return "/" + "/".join(kept) + ("/" if closed else "")


def file_identity(url: str | None) -> str | None:
    """Canonical form without scheme and fragment, or None for a null or blank URL.

    Equal results mean that the URLs differ at most in scheme, in the spelling of host (letter case,
    ``www.``, final dot), default port, path (``//``, dot segments), escapes and parameter order, in
    the fragment, in outer blanks, or in parameters of tracking and sessions.
    """
    if url is None or not (url := url.strip()):
        return None
    scheme, host, path, query = _PARTS.match(url).groups()
    if scheme and host.isdigit():  # a scheme-less host with a port
        host, scheme = f"{scheme}:{host}", None
    host = _escapes(host).lower() if "%" in host else host.lower()
    name, colon, port = host.rpartition(":")
    if colon and (port in ("", {"http": "80", "https": "443"}.get((scheme or "https").lower()))):
        host = name
    host = host.rstrip(".").removeprefix("www.")
    out = host + _path(_SESSION.sub("", path))
    kept = []
    for p in _SESSION.sub("", query or "").split("&"):
        if p:
            p = _escapes(p)
            key = p.partition("=")[0].lower()
            if key not in TRACKING and not key.startswith(TRACKING_PREFIXES):
                kept.append(p)
    return f"{out}?{'&'.join(sorted(kept))}" if kept else out


@F.pandas_udf(T.StringType())
def file_identity_column(urls: pd.Series) -> pd.Series:
    return urls.map(file_identity)
