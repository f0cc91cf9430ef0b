"""URL functions: detection and validation as native columns, expansion through an injected resolver."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.geo import COUNTRIES

#: The parts of a URL with an authority: user, host, port and the rest; white space is nowhere.
_PARTS = r"^(?:ftp|http|https)://([^\s@/?#]+@)?([^\s@/?#:]+)(:[0-9]{2,5})?([/?#]\S*)?$"
#: A label of a name begins and ends with a letter or digit, in any script of the basic plane.
_NAME = r"^(?:[0-9a-z\u00a1-\uffff](?:[-0-9a-z\u00a1-\uffff]*[0-9a-z\u00a1-\uffff])?\.)+[a-z\u00a1-\uffff]{2,}$"

_GENERIC = "com org net edu gov mil int info biz name pro aero coop museum io co ai app dev xyz online site shop blog tech cloud news eu tv me cc ws to ly gl fm am mp bar example test".split()
TLDS = tuple(sorted({*_GENERIC, *(c.lower() for c in COUNTRIES), "uk"}))
_CANDIDATE = r"(?i)((?:(?:https?|ftp)://(?:[^\s/?#@<>\"']+@)?)?(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}(?::[0-9]{2,5})?(?:[#/?][^\s<>\"']*)?)"


def _is_public_address(host: Column) -> Column:
    """Four numbers that make an address of classes A to C outside the private, local and loopback networks; nets and broadcast addresses are no hosts."""
    n = [F.split_part(host, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    written = host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & ~host.rlike(r"^0|\.0[0-9][0-9]\.|\.0[0-9]+$")
    private = n[0].isin(10, 127) | ((n[0] == 169) & (n[1] == 254)) | ((n[0] == 192) & (n[1] == 168)) | ((n[0] == 172) & n[1].between(16, 31))
    return written & n[0].between(1, 223) & n[1].between(0, 255) & n[2].between(0, 255) & n[3].between(1, 254) & ~private


def is_valid_url(url: Column) -> Column:
    """A whole http, https or ftp URL with a public host: a name with a top-level domain, or an address."""
    low = F.lower(url)
    host = F.regexp_extract(low, _PARTS, 2)
    return low.rlike(_PARTS) & (host.rlike(_NAME) | F.coalesce(_is_public_address(host), F.lit(False)))


def valid_urls(urls: Column) -> Column:
    """Those of an array that are valid, in order, repeats included."""
    return F.filter(urls, is_valid_url)


def _normal(url: Column) -> Column:
    full = F.when(url.rlike("^(?i)(?:https?|ftp)://"), url).otherwise(F.concat(F.lit("http://"), url))
    full = F.regexp_replace(full, r"[).,;:!?\]]+$", "")
    head = F.regexp_extract(full, r"^([^/]*//[^/?#]*)", 1)
    rest = F.substring(full, F.length(head) + 1, F.length(full))
    return F.concat(F.lower(head), F.when(rest == "", F.lit("/")).when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def host_tld(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://(?:[^/?#@]*@)?[^/?#:]*?([^./?#:@]+)(?::\d+)?(?:[/?#]|$)", 1)


def detect_urls(text: Column, tlds: tuple[str, ...] = TLDS) -> Column:
    """URLs in a text, with a scheme and lower-case host, whose host ends in a known top-level domain; empty for null. Runs of one sign are no trouble: the pattern is linear in them."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(1)), _normal)
    return F.coalesce(F.filter(found, lambda u: host_tld(u).isin(*tlds)), F.array().cast("array<string>"))


CHECKED = T.StructType([T.StructField("origUrl", T.StringType()), T.StructField("finalUrl", T.StringType()), T.StructField("connects", T.BooleanType()), T.StructField("numRedirects", T.IntegerType())])


@dataclass
class Unshortener:
    """Follows redirects with an injected ``resolve(url) -> location or None``; remembers final answers by the original URL."""

    resolve: Callable[[str], str | None]
    max_hops: int = 10
    cache_size: int = 100_000

    def __post_init__(self) -> None:
        self.cache: OrderedDict[str, tuple[str, str, bool, int]] = OrderedDict()

    def expand(self, url: str) -> tuple[str, str, bool, int]:
        if url in self.cache:
            self.cache.move_to_end(url)
            return self.cache[url]
        now, hops = url, 0
        try:
            while hops <= self.max_hops:
                to = self.resolve(now)
                if to is None:
                    break
                to = urljoin(now, to)
                if to == now:
                    break
                now, hops = to, hops + 1
        except Exception:  # whatever the transport raises means that it doesn't connect
            return url, now, False, hops
        found = (url, now, True, hops)
        self.cache[url] = found
        if len(self.cache) > self.cache_size:
            self.cache.popitem(last=False)
        return found

    def expands(self, url: str) -> bool:
        return self.expand(url)[3] > 0


def http_resolver(timeout: float = 3.0) -> Callable[[str], str | None]:
    """Asks for the headers of a URL and gives the ``Location`` it answers with."""
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    opener = urllib.request.build_opener(Stay)

    def resolve(url: str) -> str | None:
        import urllib.error

        try:
            with opener.open(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
                return answer.headers.get("Location")
        except urllib.error.HTTPError as error:
            if error.headers.get("Location"):
                return error.headers["Location"]
            raise

    return resolve


def expand_urls(resolver: Callable[[], Callable[[str], str | None]]):
    """Column function array<string> -> array of checked URLs; ``resolver()`` is called once a worker task."""

    @F.pandas_udf(T.ArrayType(CHECKED))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shortener = Unshortener(resolver())
        names = CHECKED.names
        for batch in batches:
            yield batch.map(lambda urls: None if urls is None else [dict(zip(names, shortener.expand(u), strict=True)) for u in urls])

    return run


def expand_with_table(urls: DataFrame, redirects: DataFrame, max_hops: int = 10) -> DataFrame:
    """(origUrl, finalUrl, numRedirects) of a column ``url`` by repeated joins with a table (url, location)."""
    steps = redirects.where("url <> location").select(F.col("url").alias("_from"), F.col("location").alias("_to"))
    now = urls.select(F.col("url").alias("origUrl"), F.col("url").alias("finalUrl"), F.lit(0).alias("numRedirects"))
    for _ in range(max_hops + 1):
        now = now.join(steps, F.col("finalUrl") == F.col("_from"), "left").select("origUrl", F.coalesce("_to", "finalUrl").alias("finalUrl"), (F.col("numRedirects") + F.col("_to").isNotNull().cast("int")).alias("numRedirects"))
    return now
