import datetime as dt
import json

import pytest

from tenderloom import vocabulary as V
from tenderloom.operators import mapping, reports
from tenderloom.schemas import LANDING
from tenderloom.sources import landing

NOTICE = {
    "numeroControlePNCP": "44935278000126-1-000343/2025",
    "objetoCompra": "Aquisição de computadores",
    "unidadeOrgao": {"ufSigla": "sp "},
    "valorTotalEstimado": 14785.32,
    "modalidadeId": 6,
    "modalidadeNome": "Pregão",
    "dataPublicacaoPncp": "2026-09-01T14:20:41",
    "dataAberturaProposta": "2026-09-02T08:00:00",
    "dataEncerramentoProposta": "2026-09-21T17:30:00",
    "dataAtualizacaoGlobal": None,
}
GONE = object()


def notice(**changes):
    return {k: v for k, v in {**NOTICE, **changes}.items() if v is not GONE}


@pytest.fixture
def mapped(spark):
    def run(*notices):
        rows = [(n, json.dumps(x, ensure_ascii=False) if not isinstance(x, str) else x)
                for n, x in enumerate(notices)]
        df = spark.createDataFrame(rows, "n int, payload string").coalesce(1)
        return mapping.map_notices(df)

    return run


def test_a_full_notice_maps(mapped):
    row = mapping.mapped_notices(mapped(notice())).first()
    assert row.control_number == NOTICE["numeroControlePNCP"]
    assert (row.state, str(row.estimated_value), row.modality_code) == ("SP", "14785.3200000000", 6)
    assert row.published_at == dt.datetime(2026, 9, 1, 17, 20, 41)
    assert row.proposal_opens_at == dt.datetime(2026, 9, 2, 11, 0)
    assert row.proposal_closes_at == dt.datetime(2026, 9, 21, 20, 30)
    assert row.source_updated_at is None and len(row.source_payload_hash) == 64


CASES = [
    (dict(valorTotalEstimado=None), V.MAPPED, None, None),
    (dict(valorTotalEstimado=GONE), V.MAPPED, None, None),
    (dict(modalidadeId=99), V.MAPPED, None, None),
    (dict(modalidadeId=6.7), V.MAPPED, None, None),
    (dict(dataAtualizacaoGlobal=GONE), V.MAPPED, None, None),
    (dict(numeroControlePNCP=GONE), V.REJECTED, "numeroControlePNCP", V.FIELD_ABSENT),
    (dict(objetoCompra="  "), V.REJECTED, "objetoCompra", V.FIELD_BLANK),
    (dict(objetoCompra="AQUISI�AO"), V.REJECTED, "objetoCompra", V.FIELD_MISDECODED),
    (dict(objetoCompra={"a": 1}), V.REJECTED, "objetoCompra", V.FIELD_BLANK),
    (dict(objetoCompra="{not an object}"), V.MAPPED, None, None),
    (dict(unidadeOrgao={"ufSigla": "XX"}), V.REJECTED, "unidadeOrgao.ufSigla", V.NOT_A_STATE + "XX"),
    (dict(unidadeOrgao={}), V.REJECTED, "ufSigla", V.FIELD_ABSENT),
    (dict(unidadeOrgao=None), V.REJECTED, "unidadeOrgao", V.UNIT_MISSING),
    (dict(modalidadeId="6"), V.REJECTED, "modalidadeId", V.NOT_WHOLE + "6"),
    (dict(modalidadeId=2**40), V.REJECTED, "modalidadeId", V.NOT_WHOLE + str(2**40)),
    (dict(modalidadeId=0), V.REJECTED, "notice", V.MODALITY_NOT_POSITIVE + "0"),
    (dict(modalidadeId=0, dataPublicacaoPncp=GONE), V.REJECTED, "notice",
     V.MODALITY_NOT_POSITIVE + "0"),
    (dict(valorTotalEstimado=-1), V.REJECTED, "valorTotalEstimado", V.NEGATIVE_VALUE + "-1"),
    (dict(valorTotalEstimado="x"), V.REJECTED, "valorTotalEstimado", V.NOT_A_NUMBER + "x"),
    (dict(dataPublicacaoPncp=GONE), V.REJECTED, "dataPublicacaoPncp", V.FIELD_ABSENT),
    (dict(dataPublicacaoPncp=None), V.REJECTED, "dataPublicacaoPncp", V.FIELD_NULL),
    (dict(dataPublicacaoPncp=""), V.REJECTED, "dataPublicacaoPncp", V.FIELD_BLANK),
    (dict(dataPublicacaoPncp="2026-09-01T14:20:41Z"), V.REJECTED, "dataPublicacaoPncp",
     V.NOT_A_TIMESTAMP + "2026-09-01T14:20:41Z"),
    (dict(dataAberturaProposta=GONE), V.REJECTED, "proposalWindow", V.NO_OPENING),
    (dict(dataEncerramentoProposta=" "), V.REJECTED, "proposalWindow", V.NO_CLOSING),
    (dict(dataEncerramentoProposta="2026-09-02T07:59:59"), V.REJECTED, "proposalWindow",
     V.CLOSES_FIRST % ("2026-09-02T11:00:00Z", "2026-09-02T10:59:59Z")),
    (dict(dataEncerramentoProposta="2026-09-02T08:00:00"), V.MAPPED, None, None),
    (dict(dataAberturaProposta=GONE, dataEncerramentoProposta=None), V.NOT_BIDDABLE, None,
     V.NO_WINDOW),
    (dict(dataAberturaProposta="soon", objetoCompra=None), V.REJECTED, "dataAberturaProposta",
     V.NOT_A_TIMESTAMP + "soon"),
]


def test_first_failed_check_decides(mapped):
    rows = mapped(*[notice(**change) for change, *_ in CASES]).orderBy("n").collect()
    assert [(r.outcome, r.field, r.reason) for r in rows] == [tuple(e) for _, *e in CASES]


def test_values_keep_their_digits(mapped):
    raw = json.dumps(notice(valorTotalEstimado="@"))
    texts = ["1234567890123456789012345678.1234567891", "1e4", "0.12345678912", "1e-12", "10.500", "1" * 30 + ".25", "1e30"]
    rows = mapped(*[raw.replace('"@"', t) for t in texts]).orderBy("n").collect()
    assert [r.outcome for r in rows] == ["mapped"] * 7
    assert [r.estimated_amount for r in rows] == [
        "1234567890123456789012345678.1234567891", "10000", "0.12345678912", "1.0E-12", "10.5",
        "1" * 30 + ".25", "1.0E30",
    ]
    # For range tests the value is cut, or the greatest there is.
    most = "9" * 28 + "." + "9" * 10
    assert [str(r.estimated_value) for r in rows] == [
        "1234567890123456789012345678.1234567891", "10000.0000000000", "0.1234567891", "0E-10",
        "10.5000000000", most, most,
    ]


def test_an_unidentified_notice(mapped):
    windowless = notice(numeroControlePNCP=None, dataAberturaProposta=GONE,
                        dataEncerramentoProposta=GONE)
    rows = mapped(windowless, notice(numeroControlePNCP=GONE), "5", "not json")
    assert [(r.outcome, r.control_number) for r in rows.orderBy("n").collect()] == [
        ("not_biddable", "unknown"), ("rejected", "unknown"), ("not_biddable", "unknown"),
        ("rejected", "unknown"),
    ]
    assert all(r.payload for r in mapping.rejected(rows).collect())


def page(number, body):
    return (dt.date(2026, 9, 1), 6, "SP", number, body)


def test_pages(spark):
    body = json.dumps({"data": [notice(), None], "totalRegistros": 99, "totalPaginas": 10,
                       "numeroPagina": 7})
    exact = '{"x": [1], "data" : [ {"v": 1.10e3, "w":12345678901234567890.5} , {"v":2}]}'
    rows = [page(1, body), page(2, ""), page(3, "<html>"), page(4, '{"status":500}'), page(5, None),
            page(6, '{"data":{}}'), page(7, '{"data":['), page(8, exact), page(9, '{"data":[]}')]
    opened = landing.open_pages(spark.createDataFrame(rows, LANDING)).collect()
    assert [bool(r.page_failure) for r in opened] == [
        False, False, True, True, False, True, True, False, False
    ]
    assert [len(r.payloads) for r in opened] == [2, 0, 0, 0, 0, 0, 0, 2, 0]
    assert (opened[0].total_records, opened[0].total_pages, opened[0].page_number) == (99, 10, 7)
    assert (opened[7].total_records, opened[7].total_pages, opened[7].page_number) == (2, 1, 8)
    assert opened[7].payloads == ['{"v": 1.10e3, "w":12345678901234567890.5}', '{"v":2}']


def test_a_fully_rejected_page_is_a_contract_change(spark):
    bad, none = notice(objetoCompra=GONE), notice(dataAberturaProposta=GONE,
                                                  dataEncerramentoProposta=GONE)
    pages = [page(1, json.dumps({"data": [bad, bad]})), page(2, json.dumps({"data": [none, bad]})),
             page(3, json.dumps({"data": []}))]
    notices = landing.page_notices(landing.open_pages(spark.createDataFrame(pages, LANDING)))
    outcome = reports.rejected_pages(mapping.map_notices(notices), ["page_number"])
    assert [(r.page_number, r.rejected) for r in outcome.collect()] == [(1, 2)]


def test_landing_folders_are_pruned(spark, tmp_path):
    rows = [(dt.date(2026, 9, d), m, s, 1, f"{d}{m}{s}")
            for d in (1, 2, 3) for m in (4, 6) for s in ("SP", "RJ")]
    path = str(tmp_path / "landing")
    landing.write_landing(spark.createDataFrame(rows, LANDING), path)
    back = landing.read_landing(spark, path)
    some = landing.scan_range(back, dt.date(2026, 9, 1), dt.date(2026, 9, 2), [6], ["SP"])
    assert sorted(r.body for r in some.collect()) == ["16SP", "26SP"]
    assert len(some.inputFiles()) <= 12
    everywhere = landing.scan_range(back, dt.date(2026, 9, 3), dt.date(2026, 9, 3), [4])
    assert sorted(r.body for r in everywhere.collect()) == ["34RJ", "34SP"]
    one = landing.scan_chunk(back, dt.date(2026, 9, 3), 4, "RJ")
    assert [r.body for r in one.collect()] == ["34RJ"]
    with pytest.raises(ValueError):
        landing.scan_range(back, dt.date(2026, 9, 3), dt.date(2026, 9, 1), [4])


def test_changed(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2")], "control_number string, source_payload_hash string")
    incoming = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], current.schema)
    assert sorted(r.control_number for r in mapping.changed(incoming, current).collect()) == ["b", "c"]
