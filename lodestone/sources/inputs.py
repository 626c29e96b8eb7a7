"""What an input names, and the items behind it: files, globs, standard input, web pages, repositories.

What an input is, is settled on the driver; folders and repositories are gone through by ``discovery``. The result is a
DataFrame of items, whose contents executors read.
"""

from __future__ import annotations

import glob
import hashlib
import ipaddress
import json
import os
import socket
import subprocess
import tempfile
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

STDIN, URL, GIT, GLOB, LOCAL = "stdin", "url", "git", "glob", "local"
DEFAULT_PORTS = {"http": 80, "https": 443}
MOST_REDIRECTS, TIMEOUT = 5, 30


class InputError(Exception):
    """A failure whose message starts with its code."""


def classify(text: str) -> str:
    """A dash is standard input; web addresses are repositories if the path ends in .git; an existing path is local even with glob characters."""
    if text == "-":
        return STDIN
    if text.lower().startswith(("http://", "https://")):
        return GIT if urllib.parse.urlsplit(text).path.endswith(".git") else URL
    if os.path.lexists(text):
        return LOCAL
    return GLOB if any(c in text for c in "*?[") else LOCAL


def normalize_url(text: str) -> str:
    """Lower-case scheme and host, no default port, no fragment; credentials and other schemes are errors."""
    u = urllib.parse.urlsplit(text.strip())
    scheme = u.scheme.lower()
    if scheme not in DEFAULT_PORTS:
        raise InputError("unsupported: only HTTP(S) URLs")
    if u.username or u.password:
        raise InputError("unsupported: URL credentials are not allowed")
    if not u.hostname:
        raise InputError("unsupported: URL requires a host")
    host = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    port = "" if u.port in (None, DEFAULT_PORTS[scheme]) else f":{u.port}"
    return urllib.parse.urlunsplit((scheme, host + port, u.path or "/", u.query, ""))


# Networks that are never fetched from, and the exceptions inside global unicast IPv6.
CLOSED_V4 = tuple(map(ipaddress.ip_network, "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()))
OPEN_V6 = ipaddress.ip_network("2000::/3")
CLOSED_V6 = tuple(map(ipaddress.ip_network, "2001::/23 2001:db8::/32 2002::/16 3fff::/16".split()))


def public_ip(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.version == 4:
        return not any(ip in n for n in CLOSED_V4)
    return ip in OPEN_V6 and not any(ip in n for n in CLOSED_V6)


def checked_addresses(url: str, allow_private: bool = False) -> list[str]:
    """The addresses of a URL's host; unless allowed, every one of them must be public."""
    u = urllib.parse.urlsplit(url)
    found = sorted({x[4][0] for x in socket.getaddrinfo(u.hostname, u.port or DEFAULT_PORTS[u.scheme], proto=socket.IPPROTO_TCP)})
    if not found or not allow_private and not all(map(public_ip, found)):
        raise InputError(f"private_network: {u.hostname}")
    return found


def extension_of(content_type: str, url: str) -> str:
    kind = content_type.split(";")[0].strip().lower()
    known = {"text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf"}.get(kind)
    return known or os.path.splitext(urllib.parse.urlsplit(url).path)[1][1:].lower() or "txt"


@dataclass
class Item:
    """One thing to extract: where it is, or what it holds."""

    uri: str
    path: str | None = None
    content: bytes | None = None
    extension: str = ""
    modified_ns: str | None = None
    metadata: dict = field(default_factory=dict)


@dataclass
class Root:
    """One scope of a sync."""

    identity: str
    kind: str
    items: list[Item] = field(default_factory=list)
    directory: str | None = None
    metadata: dict = field(default_factory=dict)
    complete: bool = True

    @property
    def id(self) -> str:
        return hashlib.sha256(self.identity.encode()).hexdigest()


def limited(stream, most: int) -> bytes:
    data = stream.read(most + 1)
    if len(data) > most:
        raise InputError(f"size_limit: more than {most} bytes")
    return data


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch(url: str, most: int, allow_private: bool = False) -> Item:
    """A page over HTTP(S): every redirect is checked anew, no proxies, bounded size and time."""
    opener = urllib.request.build_opener(_NoRedirect, urllib.request.ProxyHandler({}))
    at = normalize_url(url)
    for _ in range(MOST_REDIRECTS + 1):
        checked_addresses(at, allow_private)
        try:
            with opener.open(at, timeout=TIMEOUT) as reply:
                return Item(uri=normalize_url(url), content=limited(reply, most), extension=extension_of(reply.headers.get("Content-Type", ""), at), metadata={"final_url": at})
        except urllib.error.HTTPError as e:
            if e.code not in (301, 302, 303, 307, 308) or "Location" not in e.headers:
                raise
            at = normalize_url(urllib.parse.urljoin(at, e.headers["Location"]))
    raise InputError("unsupported: too many redirects")


def _file(path: str, uri: str | None = None, metadata: dict | None = None) -> Item:
    s = os.stat(path)
    return Item(uri=uri or "file://" + path, path=path, extension=os.path.splitext(path)[1][1:].lower(), modified_ns=str(s.st_mtime_ns), metadata=metadata or {})


def prepare(text: str, most: int = 64 << 20, source: str | None = None, stdin=None, allow_private: bool = False) -> Root:
    """The root that one input names. Single items are listed; what is in folders and repositories ``discover`` finds."""
    kind = classify(text)
    if kind == STDIN:
        data = limited(stdin, most)
        identity = f"stdin://source/{source}" if source else f"stdin://sha256/{hashlib.sha256(data).hexdigest()}"
        return Root(identity, STDIN, [Item(identity, content=data, extension="txt")])
    if kind == URL:
        item = fetch(text, most, allow_private)
        return Root(item.uri, URL, [item])
    if kind == GIT:
        at = normalize_url(text)
        if not at.startswith("https://"):
            raise InputError("unsupported: repositories only over https")
        return Root(at, GIT)
    path = os.path.realpath(text)
    if os.path.isdir(path):
        return Root("file://" + path, "directory", directory=path)
    if not os.path.isfile(path):
        raise InputError(f"input_failed: {text} is no regular file")
    return Root("file://" + path, "file", [_file(path)])


def expand(text: str) -> list[str]:
    """A glob's matches, each a root of its own; none is a failure."""
    if classify(text) != GLOB:
        return [text]
    found = sorted(glob.glob(text, recursive=True, include_hidden=True))
    if not found:
        raise InputError(f"input_failed: nothing matches {text}")
    return found


def clone(url: str, into: str) -> dict:
    """A shallow clone; what says where it is from."""
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_LFS_SKIP_SMUDGE": "1"}
    subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "clone", "--depth", "1", "--no-tags", "--", url, into], check=True, env=env, timeout=600, capture_output=True)
    say = lambda *a: subprocess.run(["git", "-C", into, *a], check=True, capture_output=True, text=True, timeout=60).stdout.strip()
    return {"repository_url": url, "branch": say("rev-parse", "--abbrev-ref", "HEAD"), "commit": say("rev-parse", "HEAD")}


ITEMS = "source_root_id string, uri string, path string, content binary, extension string, modified_ns string, metadata string"


def items(spark, roots: list[Root]):
    """The listed items of roots as a DataFrame; files come by path and are read where they are processed."""
    rows = [(r.id, i.uri, i.path, i.content, i.extension, i.modified_ns, json.dumps(r.metadata | i.metadata, sort_keys=True)) for r in roots for i in r.items]
    return spark.createDataFrame(rows, ITEMS)


def discover(spark, root: Root, store: str, most: int = 64 << 20):
    """All items of a root as a DataFrame. Sets the root's ``complete``, and the metadata of a repository.

    Files of a folder are found in tasks and come by path; those of a repository come with their contents, which are kept
    under ``store``. A repository's clone is gone when this returns.
    """
    from . import discovery

    none = F.lit(None)
    if root.kind == GIT:
        with tempfile.TemporaryDirectory(prefix="lodestone-git-") as into:
            root.metadata = clone(root.identity, into)
            found, root.complete = discovery.stored_tree(spark, into, f"{store}/{root.id}", most)
        ending = F.regexp_extract(F.lower("path"), r"[^/]\.([^./]*)$", 1)
        uri, path, content, modified = F.concat(F.lit(root.identity + "#"), "path"), none, F.col("content"), none
    elif root.directory:
        listed = discovery.listing(spark, root.directory)
        root.complete = not listed.filter(F.col("kind") == discovery.BAD).limit(1).count()
        found = listed.filter(F.col("kind") == discovery.FILE)
        uri, path, content, ending, modified = F.concat(F.lit("file://"), "path"), F.col("path"), none, F.col("extension"), F.col("modified_ns")
    else:
        return items(spark, [root])
    return found.select(
        F.lit(root.id).alias("source_root_id"), uri.alias("uri"), path.cast("string").alias("path"), content.cast("binary").alias("content"), ending.alias("extension"),
        modified.cast("string").alias("modified_ns"), F.lit(json.dumps(root.metadata, sort_keys=True)).alias("metadata"),
    )


def read_stable(path: str, most: int) -> bytes:
    """A file whose size and time did not change while it was read."""
    with open(path, "rb") as f:
        before = os.fstat(f.fileno())
        data = limited(f, most)
        after = os.fstat(f.fileno())
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or len(data) != after.st_size:
        raise InputError("changed_while_reading")
    return data


def checked_lines(path: str, sha256: str, most: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a file with a known hash; blank and overlong lines and a wrong hash are errors."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for line in iter(lambda: f.readline(most + 2), b""):
            digest.update(line)
            body = line.rstrip(b"\r\n")
            if len(body) > most or not body.strip():
                raise InputError("size_limit: line" if body.strip() else "unsupported: blank line")
            yield body
    if digest.hexdigest() != sha256:
        raise InputError(f"unsupported: wrong hash of {path}")


def ensure_file(url: str, path: str, sha256: str, most: int = 4 << 30, attempts: int = 3, get=fetch) -> str:
    """A cached download with a known hash: tried again on failure, put in place only once the hash is right."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() == sha256:
                return path
    problem: Exception | None = None
    for _ in range(attempts):
        try:
            data = get(url, most).content
        except (InputError, OSError) as e:
            problem = e
            continue
        if hashlib.sha256(data).hexdigest() != sha256:
            problem = InputError(f"input_failed: wrong hash of {url}")
            continue
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
            f.write(data)
        os.replace(f.name, path)
        return path
    raise problem or InputError("input_failed")
