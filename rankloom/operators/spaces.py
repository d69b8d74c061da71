"""Search spaces of the models, by the names of their parameters here."""

from __future__ import annotations

from .search import Space

# The ranges that are searched for each model.
NEIGHBOURS = {"top_k": Space(5, 1000, integer=True), "shrink": Space(0, 1000, integer=True)}
NORMALIZE = {"normalize": Space(choices=(True, False))}
KNN = {
    "cosine": {**NEIGHBOURS, **NORMALIZE},
    "adjusted": {**NEIGHBOURS, **NORMALIZE},
    "pearson": {**NEIGHBOURS, **NORMALIZE},
    "jaccard": {**NEIGHBOURS, **NORMALIZE},
    "dice": {**NEIGHBOURS, **NORMALIZE},
    "asymmetric": {**NEIGHBOURS, "asymmetric_alpha": Space(0, 2), "normalize": Space(choices=(True,))},
    "tversky": {**NEIGHBOURS, "tversky_alpha": Space(0, 2), "tversky_beta": Space(0, 2), "normalize": Space(choices=(True,))},
    "euclidean": {**NEIGHBOURS, **NORMALIZE, "mode": Space(choices=("lin", "log", "exp"))},
}
WEIGHTING = {"feature_weighting": Space(choices=("none", "BM25", "TF-IDF"))}
HYBRID = {"feature_weight": Space(1e-2, 1e2, log=True)}
MODELS = {
    "top_pop": {},
    "global_effects": {},
    "random": {},
    "p3alpha": {"top_k": Space(5, 1000, integer=True), "alpha": Space(0, 2), "normalise": Space(choices=(True, False))},
    "rp3beta": {"top_k": Space(5, 1000, integer=True), "alpha": Space(0, 2), "beta": Space(0, 2), "normalise": Space(choices=(True, False))},
    "ials": {"factors": Space(1, 200, integer=True), "epochs": Space(choices=(300,)), "scaling": Space(choices=("linear", "log")), "alpha": Space(1e-3, 50.0, log=True), "epsilon": Space(1e-3, 10.0, log=True), "reg": Space(1e-5, 1e-2, log=True)},
    "pure_svd": {"factors": Space(1, 350, integer=True)},
    "pure_svd_item": {"factors": Space(1, 350, integer=True), "top_k": Space(5, 1000, integer=True)},
    "nmf": {"factors": Space(1, 350, integer=True)},
    "slim_elastic_net": {"top_k": Space(5, 1000, integer=True), "l1_ratio": Space(1e-5, 1.0, log=True), "alpha": Space(1e-3, 1.0)},
    "ease_r": {"top_k": Space(choices=(None,)), "l2": Space(1e0, 1e7, log=True)},
    "mf_mse": {"factors": Space(1, 200, integer=True), "epochs": Space(choices=(500,)), "biases": Space(choices=(True, False)), "reg": Space(1e-5, 1e-2, log=True), "rate": Space(1e-4, 1e-1, log=True)},
    "asy_svd": {"factors": Space(1, 200, integer=True), "epochs": Space(choices=(500,)), "reg": Space(1e-5, 1e-2, log=True), "rate": Space(1e-4, 1e-1, log=True)},
    "bpr_factors": {"factors": Space(1, 200, integer=True), "epochs": Space(choices=(1500,)), "reg": Space(1e-5, 1e-2, log=True), "rate": Space(1e-4, 1e-1, log=True)},
    "slim_bpr": {"top_k": Space(5, 1000, integer=True), "epochs": Space(choices=(1500,)), "symmetric": Space(choices=(True, False)), "reg_positive": Space(1e-5, 1e-2, log=True), "reg_negative": Space(1e-5, 1e-2, log=True), "rate": Space(1e-4, 1e-1, log=True)},
}


def knn(kind: str, weighting: bool = False, hybrid: bool = False) -> dict[str, Space]:
    """The space of a neighbourhood model with one similarity."""
    return {**KNN[kind], **(WEIGHTING if weighting and kind in ("cosine", "asymmetric", "euclidean") else {}), **(HYBRID if hybrid else {})}
