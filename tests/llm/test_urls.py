"""The URL filter over the whole table of pages against a plain version of rules, models and threshold."""

import math
from collections import Counter, defaultdict
from statistics import median

import xxhash
from pyspark.sql import functions as F

from linework.llm import url_filter

RULES = [("net", "", "block"), ("example.net", "en/", "allow"), ("example.com", "de/", "block"), ("org", "fr/", "allow")]


def parts(url):
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:].split("?", 1)[0].split("#", 1)[0]


def ruled(host, path):
    fit = [(f"{h}/{p}", v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def kinds(url):
    out = []
    for b in url.encode() + b"\0":
        c = chr(b).lower() if 65 <= b <= 90 else chr(b)
        out.append("0" if c in "123456789" else c if c in url_filter.LETTERS else "other")
    return out


class Model:
    def __init__(self, urls):
        self.seen = defaultdict(Counter)
        for text, before in self.steps(urls):
            for n in range(url_filter.ORDER + 1):
                self.seen[tuple(before[url_filter.ORDER - n :])][text] += 1

    @staticmethod
    def steps(urls):
        for url in urls:
            codes = ["\0"] * url_filter.ORDER + kinds(url)
            for k in range(url_filter.ORDER, len(codes)):
                yield codes[k], codes[k - url_filter.ORDER : k]

    def log_p(self, text, before):
        p = 1.0 / (len(url_filter.LETTERS) + 1)
        for n in range(url_filter.ORDER + 1):
            after = self.seen.get(tuple(before[url_filter.ORDER - n :]))
            if after:
                total, different = sum(after.values()), len(after)
                p = (after[text] + different * p) / (total + different)
        return math.log(p)


def side(url):
    signed = int.from_bytes(xxhash.xxh64(url.encode(), seed=42).digest(), "big", signed=True)
    return signed % url_filter.CALIBRATION


def test_all_pages_equal_the_plain_version(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(-k, u) for k, u in enumerate(["http://h.com/ü;x=1", "HTTP://UPPER.com/A?b", None, "", "no scheme", "http://deep.a.org/fr/x#y", "http://h.com/" + "long/" * 2000], 1)], "page_id long, url string")
    rows = pages.unionByName(more)
    own = [(r.page_id, r.url or "") for r in rows.collect()]
    labelled = [(u, ruled(*parts(u))[1]) for _, u in own if ruled(*parts(u))[1]]
    models = {v: Model(u for u, of in labelled if of == v and side(u) != 0) for v in ("allow", "block")}

    def score(url):
        steps = list(Model.steps([url]))
        return sum(models["allow"].log_p(*s) - models["block"].log_p(*s) for s in steps) / len(steps)

    held = [(min(max(score(u), -url_filter.LIMIT), url_filter.LIMIT), v) for u, v in labelled if side(u) == 0]
    bins = [(math.floor((s + url_filter.LIMIT) / (2 * url_filter.LIMIT) * url_filter.BINS), v) for s, v in held]
    many = Counter(v for _, v in bins)
    assert many["allow"] and many["block"]
    wrong = [sum(v == "allow" and b < edge for b, v in bins) / many["allow"] + sum(v == "block" and b >= edge for b, v in bins) / many["block"] for edge in range(url_filter.BINS + 1)]
    least = min(wrong)
    threshold = median(e for e, w in enumerate(wrong) if w < least + 1e-9) / url_filter.BINS * 2 * url_filter.LIMIT - url_filter.LIMIT

    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert len(got) == len(own)
    for page, url in own:
        (host, path), r = parts(url), got[page]
        rule, verdict = ruled(host, path)
        plain = score(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.score - plain) < 1e-4
        if verdict or abs(plain - threshold) > 1e-4:
            assert r.verdict == (verdict or ("block" if plain < threshold else "allow"))
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}
    assert rows.filter(F.col("url").isNull()).count() == 1
