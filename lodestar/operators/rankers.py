"""Rankers as column factories.

``term`` gives what one query term adds to a document's score; ``doc`` what is added once for each document.
Columns at hand: tf, dl, df, cf, n, l, adl, qlen (terms of the query, repeated ones included), all doubles. A term's
contribution that isn't finite counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class Columns:
    """``c.tf``, ``c.dl`` and so on."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name).cast("double")


c = Columns()


@dataclass(frozen=True)
class Ranker:
    name: str
    term: Callable[[], Column]
    doc: Callable[[], Column] | None = None
    #: Extra columns: per document (joined to the candidates) or per term.
    needs: tuple[str, ...] = ()
    #: Can be computed when an index is made, and so be stored as impacts.
    quantable: bool = True
    parameters: dict[str, float] = field(default_factory=dict)


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _idf() -> Column:
    return F.log(c.n / c.df)


def _norm(b: float) -> Column:
    return (1 - b) + b * c.dl / c.adl


def bm25(k1: float = 0.9, b: float = 0.4) -> Ranker:
    return Ranker("bm25", lambda: _idf() * c.tf * (k1 + 1) / (c.tf + k1 * _norm(b)), parameters={"k1": k1, "b": b})


def bm25l(k1: float = 0.9, b: float = 0.4, d: float = 0.5) -> Ranker:
    def term() -> Column:
        t = c.tf / _norm(b)
        return _idf() * (k1 + 1) * (t + d) / (k1 + t + d)

    return Ranker("bm25l", term, quantable=False)


def bm25plus(k1: float = 0.9, b: float = 0.4, d: float = 1.0) -> Ranker:
    return Ranker("bm25plus", lambda: _idf() * ((k1 + 1) * c.tf / (k1 * _norm(b) + c.tf) + d))


def bm25t(b: float = 0.2) -> Ranker:
    """Every term has its own k1, from :func:`lodestar.operators.term_models.bm25t_k1`."""

    def term() -> Column:
        t = c.tf / _norm(b)
        return _idf() * (c.k1 + 1) * t / (c.k1 + t)

    return Ranker("bm25t", term, needs=("k1",), quantable=False, parameters={"b": b})


def bm25adpt(b: float = 0.3) -> Ranker:
    """k1 and gain of every term come from :func:`lodestar.operators.term_models.bm25adpt_k1`."""

    def term() -> Column:
        t = c.tf / _norm(b)
        return c.gain * (c.k1 + 1) * t / (c.k1 + t)

    return Ranker("bm25adpt", term, needs=("k1", "gain"), quantable=False, parameters={"b": b})


def tflodop(b: float = 0.1, d: float = 0.1) -> Ranker:
    return Ranker("tflodop", lambda: (1 + F.log(1 + F.log(c.tf / _norm(b) + d))) * F.log((c.n + 1) / c.df))


def lmd(u: float = 6750.0) -> Ranker:
    return Ranker("lmd", lambda: F.log(1 + (c.tf / u) * (c.l / c.cf)) - c.qlen * F.log(1 + c.dl / u))


def lmds(u: float = 2500.0) -> Ranker:
    return Ranker("lmds", lambda: F.log((c.tf / u) * (c.l / c.cf) + 1), lambda: c.qlen * F.log(u / (c.dl + u)))


def lmjm(lam: float = 0.5) -> Ranker:
    return Ranker("lmjm", lambda: F.log(1 + ((1 - lam) / lam) * (c.tf / c.dl) * (c.l / c.cf)))


def _log_sum(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b))."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def discounted(tf: Column, g: float) -> Column:
    return F.greatest(tf - g * F.pow(tf, g), F.lit(0.0))


def lmp(u: float = 1000.0, g: float = 0.5) -> Ranker:
    """Pitman-Yor with a power-law discount; ``disc`` is the document's discounted length."""

    def term() -> Column:
        t = discounted(c.tf, g)
        return F.when(t > 0, _log_sum(F.log(t) + F.log(c.l) - F.log(u * c.cf + 1), F.lit(0.0))).otherwise(0.0)

    return Ranker("lmp", term, lambda: c.qlen * F.log(1 - c.disc / (c.dl + u)), needs=("disc",), parameters={"g": g})


def lmptfidf(u: float = 1000.0, g: float = 0.5) -> Ranker:
    """The same over tf.idf weights; ``uniq``, ``tfidf_len`` and ``tfidf_disc`` are the document's, ``v`` the vocabulary's size."""

    def term() -> Column:
        t = discounted(F.log(1 + c.tf / c.uniq) * _idf(), g)
        return F.when(t > 0, _idf() * F.log(t * c.v / u + 1)).otherwise(0.0)

    return Ranker("lmptfidf", term, lambda: c.qlen * F.log(1 - c.tfidf_disc / (c.tfidf_len + u)), needs=("uniq", "tfidf_len", "tfidf_disc", "v"), parameters={"g": g})


def divergence() -> Ranker:
    def term() -> Column:
        t = c.tf * F.log2(1 + c.adl / c.dl)
        ne = c.n * (1 - F.pow((c.n - 1) / c.n, c.cf))
        return t * F.log2((c.n + 1) / (ne + 0.5)) * (c.cf + 1) / (c.df * (t + 1))

    return Ranker("divergence", term)


def bose_einstein() -> Ranker:
    def term() -> Column:
        t = c.tf * F.log(1 + c.adl / c.dl)
        return (F.log(1 + c.cf / c.n) + t * F.log(1 + c.n / c.cf)) / (t + 1)

    return Ranker("be", term)


def _tail(f: Column) -> Column:
    return 0.5 * F.log2(2 * math.pi * c.tf * (1 - f))


def _gain() -> Column:
    return c.tf * F.log2((c.tf * c.adl / c.dl) * (c.n / c.cf))


def dlh13() -> Ranker:
    return Ranker("dlh13", lambda: (_gain() + _tail(c.tf / c.dl)) / (c.tf + 0.5) + 10)


def dph() -> Ranker:
    def term() -> Column:
        f = c.tf / c.dl
        return F.pow(1 - f, F.lit(2)) / (c.tf + 1) * (_gain() + _tail(f))

    return Ranker("dph", term)


def dfree() -> Ranker:
    def term() -> Column:
        prior, post, inv = c.tf / c.dl, (c.tf + 1) / (c.dl + 1), c.l / c.tf
        return c.tf * F.log2(post / prior) * (-c.tf * F.log2(prior * inv) + (c.tf + 1) * F.log2(post * inv) + 0.5 * F.log2(post / prior))

    return Ranker("dfree", term)


def _dfi(weight: Callable[[], Column] | None) -> Callable[[], Column]:
    def term() -> Column:
        expected = c.cf * c.dl / c.l
        base = F.log2((c.tf - expected) / F.sqrt(expected) + 1)
        return F.when(c.tf > expected, base * weight() if weight else base).otherwise(0.0)

    return term


def dfi() -> Ranker:
    return Ranker("dfi", _dfi(None))


def dfiw() -> Ranker:
    return Ranker("dfiw", _dfi(lambda: -F.log2(c.tf / c.dl)))


def dfi_idf() -> Ranker:
    return Ranker("dfi_idf", _dfi(lambda: F.log2(c.n / c.df)))


def dfiw_idf() -> Ranker:
    return Ranker("dfiw_idf", _dfi(lambda: F.log2(c.n / c.df) * -F.log2(c.tf / c.dl)))


def tfidf() -> Ranker:
    return Ranker("tfidf", lambda: c.tf * _idf() * _idf() / 100)


def kbtfidf(k: float = 5.0, b: float = 2.281718171540955) -> Ranker:
    return Ranker("kbtfidf", lambda: F.log(k * c.tf - b) * _idf() * _idf() / 100)


def term_count() -> Ranker:
    return Ranker("termcount", lambda: F.lit(1.0), quantable=False)


def impact() -> Ranker:
    """Sum of stored impacts, which stand in tf."""
    return Ranker("impact", lambda: c.tf, quantable=False)


def docid(direction: int = 1) -> Ranker:
    """Newest first (1: number of documents less docid) or last (0: docid + 1)."""
    return Ranker("docid", lambda: F.lit(0.0), lambda: c.n - c.docid if direction else c.docid + 1, quantable=False)


def pregen(top: float | None = None) -> Ranker:
    """A static value of the document, joined as ``pregen``; with ``top``, ascending."""
    return Ranker("pregen", lambda: F.lit(0.0), lambda: top - c.pregen if top is not None else c.pregen, needs=("pregen",), quantable=False)


def readable(mix: float = 0.5, cutoff: float = 20.0) -> Ranker:
    """BM25 mixed with how far the document's ``readability`` (thousandths) stays under a cut-off."""
    base = bm25()
    return Ranker("readable", lambda: mix * base.term(), lambda: (1 - mix) * (cutoff - c.readability / 1000), needs=("readability",), quantable=False)


RANKERS: dict[str, Callable[..., Ranker]] = {
    "bm25": bm25,
    "bm25l": bm25l,
    "bm25plus": bm25plus,
    "bm25t": bm25t,
    "bm25adpt": bm25adpt,
    "tflodop": tflodop,
    "lmd": lmd,
    "lmds": lmds,
    "lmp": lmp,
    "lmptfidf": lmptfidf,
    "lmjm": lmjm,
    "divergence": divergence,
    "be": bose_einstein,
    "dlh13": dlh13,
    "dph": dph,
    "dfree": dfree,
    "dfi": dfi,
    "dfiw": dfiw,
    "dfi_idf": dfi_idf,
    "dfiw_idf": dfiw_idf,
    "tfidf": tfidf,
    "kbtfidf": kbtfidf,
    "termcount": term_count,
    "allterms": term_count,
    "impact": impact,
    "docid": docid,
    "pregen": pregen,
    "readable": readable,
}


def ranker(spec: str) -> Ranker:
    """A ranker from ``name`` or ``name:parameter:parameter``."""
    name, *rest = spec.lower().split(":")
    return RANKERS[name](*(float(x) for x in rest))


def register(name: str, make: Callable[..., Ranker]) -> None:
    RANKERS[name] = make
