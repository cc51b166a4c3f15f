"""Claim extraction on sentences of our own, one for each rule."""

import pytest

from plumbline.operators.claims import ClaimSettings, extract_claims

CASES = [
    # title, body, expected (mode, target) of the only claim, or None
    ("", "El alcalde asegura que la obra del puente costó 20 millones de soles.", ("reported_claim", "la obra del puente costó 20 millones de soles")),
    ("", "La ministra niega que el hospital regional cerró en marzo pasado.", ("refutation_projected", "el hospital regional cerró en marzo pasado")),
    ("Newtral: ¿El congreso aprobó cerrar los colegios? Es falso, no hubo votación", "", ("factcheck_question", "El congreso aprobó cerrar los colegios")),
    ("Es falso que la vacuna contiene chips de rastreo", "", ("factcheck_verdict", "la vacuna contiene chips de rastreo")),
    ("Es falso el video que demostraría que Lima quedó sin agua potable", "", ("factcheck_embedded", "lima quedo sin agua potable")),
    ("", "Según el informe anual, la pobreza bajó cuatro puntos en la sierra norte.", ("reported_claim", "la pobreza bajó cuatro puntos en la sierra norte")),
    ("", "El vocero dijo esta mañana ante la prensa que la deuda subió a 300 millones.", ("reported_claim", "la deuda subió a 300 millones")),
    ("", "Leer resumen de la nota con 45 datos sobre el presupuesto del año.", None),
    ("", "AB-12 es el código del expediente que firmó la oficina central.", None),
    ("", "2024 fue el año con más lluvias registradas en toda la costa norte.", None),
    ("", "Yo creo que el presupuesto de 2023 fue muy alto para la región.", None),
    ("", "El diputado afirma que es necesario cambiar las normas de tránsito ya.", None),
    ("", "El clima de la región estuvo templado durante toda la semana pasada.", None),
    ("", "¿Cuándo se publicarán los 12 informes que pidió la comisión de salud?", None),
    ("", "El funcionario dijo que su oficina tendrá nuevos muebles el próximo verano.", None),
    ("", "El acta de 2022 tiene 15 páginas firmadas por los miembros del consejo.", ("verbatim", "El acta de 2022 tiene 15 páginas firmadas por los miembros del consejo")),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(CASES)], "doc_id long, title string, body string")
    out = {}
    for r in extract_claims(rows).collect():
        out.setdefault(r["doc_id"], []).append((r["mode"], r["target"]))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    want = CASES[i][2]
    assert found.get(i, []) == ([] if want is None else [want])


def test_model_input_keeps_the_source_unless_there_is_none(spark):
    rows = spark.createDataFrame([(1, "", "También mencionó que la planta produjo 40 toneladas de arroz."), (2, "", "La ONPE reportó que votaron 9 millones de personas en Lima.")], "doc_id long, title string, body string")
    got = {r["doc_id"]: r["model_input"] for r in extract_claims(rows).collect()}
    assert got == {1: "la planta produjo 40 toneladas de arroz", 2: "La ONPE reportó que votaron 9 millones de personas en Lima"}


def test_rank_cap_and_dedupe(spark):
    body = " ".join(f"El municipio gastó {n} soles en la obra número {n} del distrito." for n in range(50)) + " El municipio gastó 3 soles en la obra número 3 del distrito. La Contraloría confirma que Pedro Rojas firmó 8 contratos en Lima."
    rows = spark.createDataFrame([(1, None, body)], "doc_id long, title string, body string")
    assert [r["rank"] for r in extract_claims(rows).orderBy("rank").collect()] == [1, 2, 3]
    all_ = extract_claims(rows, ClaimSettings(max_claims=100)).collect()
    assert len(all_) == 30 and len({r["target"] for r in all_}) == 30
    assert extract_claims(rows, ClaimSettings(max_claims=1, max_candidates=100)).first()["mode"] == "reported_claim"


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", " ")], "doc_id long, title string, body string")
    assert extract_claims(rows).count() == 0
