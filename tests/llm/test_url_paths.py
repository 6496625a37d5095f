"""The URL model: held-out labels, the path as evidence, and what it does with addresses it knows nothing of."""

from __future__ import annotations

import numpy as np
import pytest

from tracewell.llm import urls

#: Labels, hosts and paths that the table does not have.
WANTED = """quorvane.net/ tibelloph.org/a harwick.co.uk/library/ mastrupen.com/about/contact zurich.ch/plan/strassen kinderbuch.at/lesen weather-station.io/data
bergsteiger.de/touren/alpen cuisine-du-sud.fr/recettes librarycat.org/catalog musicschool.edu.au/courses observatory.cl/news/comet teahouse.jp/menu
railmuseum.nl/collection gardenclub.ca/seeds mathcircle.org/problems wetlands.org.au/birds hospital.se/visit council.gov.ie/parking orchestra.fi/concerts""".split()
UNWANTED = """grandcasinonights.com/ vegas-slots-bonus.site/spin poker-freeroll-bonus.win/ livesexcam-girls.net/ amateurporn-videos.org/ adult-sex-chat.info/
generic-viagra-pills.shop/ onlinepharmacy-cialis.biz/order instant-cash-loans.top/apply crack-serial-download.info/ banner-ads-network.biz/click
cheap-replica-watches.shop/ sportsbetting-bonus.club/ free-gift-card-winner.xyz/claim account-verify-login.click/update backlinks-seo-cheap.biz/""".split()


@pytest.fixture(scope="module")
def model():
    return urls.UrlModel.train(urls.training_table())


def verdicts(model, addresses):
    return np.array([model.score(host, "/" + path) >= 0.5 for host, path in (a.split("/", 1) for a in addresses)])


def test_held_out_labels(model):
    table = {a.split("/")[0] for a in (*urls.WANTED, *urls.UNWANTED)}
    assert not table & {a.split("/")[0] for a in (*WANTED, *UNWANTED)} and len(urls.WANTED) + len(urls.UNWANTED) <= 200
    assert verdicts(model, WANTED).mean() <= 0.1
    assert verdicts(model, UNWANTED).mean() >= 0.8


def test_cross_validation(monkeypatch):
    """A fifth of the addresses held out at a time: the rate that the README gives."""
    wanted, unwanted, right = list(urls.WANTED), list(urls.UNWANTED), {0: [], 1: []}
    neutral = urls.FIRST_INNOCENT
    for k in range(5):
        monkeypatch.setattr(urls, "WANTED", [a for i, a in enumerate(wanted) if i % 5 != k])
        monkeypatch.setattr(urls, "UNWANTED", [a for i, a in enumerate(unwanted) if i % 5 != k or a == neutral])
        m = urls.UrlModel.train(urls.training_table())
        right[0] += (~verdicts(m, wanted[k::5])).tolist()
        right[1] += verdicts(m, [a for a in unwanted[k::5] if a != neutral]).tolist()
    assert np.mean(right[0]) >= 0.97 and np.mean(right[1]) >= 0.8


def test_paths_are_evidence(model):
    for host in ("quorvane.example.net", "www.tibelloph.org", "m.harwick.co.uk"):
        for path in ("/casino-bonus/", "/porn-videos/", "/buy-viagra/", "/pills/buy-now"):
            assert model.score(host, path) > 2 * model.score(host, "/library/")
        for path in ("/", "/library/", "/news/2024/5.html", "/wiki/history", "/about/contact"):
            assert model.score(host, path) < 0.5, (host, path)


def test_nothing_learned(model):
    assert model.score("", "") < 0.5 and model.score("qqqq", "") == pytest.approx(0.1, abs=0.1)
    empty = urls.UrlModel.train([])
    assert empty.score("a.b", "/c") == pytest.approx(0.1)
