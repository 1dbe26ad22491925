"""Pasted lists of jobs, as people paste them."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.sources import pastes, tables

TODAY = date(2026, 5, 20)
AGO = lambda n: TODAY - timedelta(days=n)
CASES = {
    "company then role": ("\n InCommon\n\n Engineering Manager - Platform Engineering\n Add note\n Applied 1w ago\n", [("InCommon", "Engineering Manager - Platform Engineering", AGO(7))]),
    "role then bullet": ("Add note\nPrincipal Engineer\nSerko · Bengaluru (Hybrid)\nApplied 2d ago", [("Serko", "Principal Engineer", AGO(2))]),
    "role at company": ("Software Engineer at Acme Corp\nApplied today", [("Acme", "Software Engineer", TODAY)]),
    "several": ("Alpha Inc\nBackend Engineer\nApplied 1w ago\nBeta LLC\nFrontend Engineer\nApplied 3d ago", [("Alpha", "Backend Engineer", AGO(7)), ("Beta", "Frontend Engineer", AGO(3))]),
    "status word": ("Gamma Corp\nData Scientist\nArchived", [("Gamma", "Data Scientist", None)]),
    "noise": ("Easy Apply\nPromoted\nDelta Inc\nQA Engineer\n123 applicants\nApplied yesterday", [("Delta", "QA Engineer", AGO(1))]),
    "place": ("Epsilon Corp\nSite Reliability Engineer\nBengaluru, India\nApplied 3w ago", [("Epsilon", "Site Reliability Engineer", AGO(21))]),
    "hours": ("Zeta Inc\nDevOps Engineer\nApplied 5h ago", [("Zeta", "DevOps Engineer", TODAY)]),
    "months": ("Theta LLC\nStaff Engineer\nApplied 2mo ago", [("Theta", "Staff Engineer", AGO(60))]),
    "blank": ("   \n  \n ", []),
    "no end": ("Iota Corp\nProduct Manager", [("Iota", "Product Manager", None)]),
    "legal form": ("Kappa Technologies Inc.\nBackend Developer\nApplied 1d ago", [("Kappa Technologies", "Backend Developer", AGO(1))]),
    "bullet of places first": ("Remote · Pune · Lambda Ltd\nCook\nIn  progress", [("Lambda", "Cook", None)]),
    "place and title": ("Muon\nDirector, Platform\nSpringfield, Ohio\nApplied 1 day ago", [("Muon", "Director, Platform", AGO(1))]),
    "role alone": ("Welder\nSaved", [(None, "Welder", None)]),
    "only a bullet": ("Nu Systems · London\nClosed\nApplied 2w ago", [("Nu Systems", None, None)]),
}


@pytest.fixture(scope="module")
def entries(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [("null", None)], "paste_id string, text string")
    out = {}
    for r in sorted(pastes.pasted(df, F.lit(TODAY)).collect(), key=lambda r: r.n):
        out.setdefault(r.paste_id, []).append((r.company, r.role, r.applied_on))
    return out


@pytest.mark.parametrize("case", list(CASES))
def test_paste(entries, case):
    assert entries.get(case, []) == CASES[case][1]


def test_null_text(entries):
    assert "null" not in entries


def test_a_sheet_with_an_unreadable_date_is_an_error(spark):
    df = lambda d: spark.createDataFrame([("Acme", "Cook", None, "offer", d)], "company string, role string, portal string, status string, applied string")
    assert [r.applied_on for d in ("2026-05-01", "2026-05-01 09:30:00") for r in tables.sheet(df(d)).collect()] == [date(2026, 5, 1)] * 2
    for wrong in ("1 May 2026", "01/05/2026", "soon", None):
        with pytest.raises(Exception, match="date"):
            tables.sheet(df(wrong)).collect()
