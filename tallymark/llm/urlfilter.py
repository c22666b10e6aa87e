"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import batch_column

#: (host, path, verdict); a rule is written host + path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Terms in the pages' languages, by weight. One strict term is enough, two soft or three weak different ones are.
LIMIT = 6
STRICT = ("porn", "porno", "pornos", "xxx", "xvideos", "hentai", "camgirls", "milf", "escorts", "warez", "keygen",
          "torrents", "pornographie", "pornografia", "sexfilme", "sexcams", "putas")
SOFT = ("sex", "sexe", "sexo", "sexy", "nude", "nackt", "desnudas", "erotic", "erotik", "erotique", "erotico", "escort",
        "casino", "poker", "betting", "wetten", "apuestas", "jackpot", "viagra", "cialis")
WEAK = ("adult", "adulte", "adultos", "erwachsene", "dating", "webcam", "payday", "crack", "serial", "pills", "pillen",
        "pilules", "pastillas", "lotto", "loterie", "loteria", "bonus", "gratis")
WEIGHTS = tuple((term, weight) for terms, weight in ((STRICT, LIMIT), (SOFT, 3), (WEAK, 2)) for term in terms)

_AFTER = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Vocabulary:
    """Terms with their weights, and the sum over different terms that rejects a URL.

    Terms are lower-case letters and digits; a hit must be bounded by other characters. A term that weighs
    ``limit`` is strict, any other soft.
    """

    weights: tuple[tuple[str, int], ...] = WEIGHTS
    limit: int = LIMIT


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for NULL or where there is no ``://``."""
    found = _AFTER.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def _judge(config):
    rules, vocabulary = config
    by_host: dict[str, list] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict, host + path))
    automaton = ahocorasick.Automaton()
    for term, weight in vocabulary.weights:
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()

    def method(url: str) -> tuple[str, int, int]:
        text, hits = unquote(url).translate(_UPPER), {}
        for end, (term, weight) in automaton.iter(text):
            start = end - len(term)
            around = (text[start] if start >= 0 else " ") + text[end + 1:end + 2]
            if not any(c.isalnum() for c in around):
                hits[term] = weight
        strict = sum(weight >= vocabulary.limit for weight in hits.values())
        return "block" if sum(hits.values()) >= vocabulary.limit else "allow", strict, len(hits) - strict

    def work(urls):
        rows = []
        for url in urls:
            host, path = host_and_path(url)
            best, labels = None, host.split(".")
            for k in range(len(labels)):
                for start, verdict, name in by_host.get(".".join(labels[k:]), ()):
                    if path.startswith(start) and (best is None or len(name) > len(best[1])):
                        best = verdict, name
            verdict, strict, soft = method(url or "")
            rows.append((host, path, best and best[1], best[0] if best else verdict, strict, soft))
        return list(zip(*rows))

    return work


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = Vocabulary(),
               url: str = "url", into: str = "judged") -> DataFrame:
    """``pages`` plus a struct ``into``: host, path, rule, verdict, strict_hits, soft_hits.

    A rule fits its host and every subdomain where the path starts with the rule's path; the longest
    rule decides. Without one the vocabulary does: block if the weights of the different terms found
    anywhere in the URL, percent signs decoded, reach its limit; each must be bounded by something other
    than a letter or digit; repeats count once. A NULL or malformed URL has an empty host and path and fits
    no rule. A column that is called like ``into`` gives way to it.
    """
    kind = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int"
    fields = {"host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(),
              "strict_hits": pa.int32(), "soft_hits": pa.int32()}
    config = pages.sparkSession.sparkContext.broadcast((tuple(rules), vocabulary))
    return pages.withColumn(into, batch_column(F.col(url), kind, fields, _judge, config))
