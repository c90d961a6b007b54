"""Bill layouts as data. A new issuer is one more entry here and one rule in the router."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from aquabill.functions import text as T

#: i: any case, u: also beyond ASCII, d: only LF ends a line, U: Unicode white space and word characters.
FLAGS, DOTALL = "(?iudU)", "(?iudsU)"


def first(pattern: str, group: int = 1, flags: str = FLAGS) -> Callable[[Column], Column]:
    """The first match's group, '' without one."""
    return lambda block: F.regexp_extract(block, flags + pattern, group)


def stripped(pattern: str, group: int = 1, flags: str = FLAGS) -> Callable[[Column], Column]:
    return lambda block: T.strip(first(pattern, group, flags)(block))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) for an f that reads value several times, in branches too, where Spark would look for it again each time."""
    return F.transform(F.array(value), f)[0]


def match(pattern: str) -> Callable[[Column], Column]:
    """The first match, '' without one. Groups are then read from it alone, so the pattern must not look around its match."""
    return first(pattern, 0)


def of_match(pattern: str, group: int) -> Callable[[Column], Column]:
    """As first(), for a pattern of which several fields are groups: it is looked for once."""
    return lambda block: first(pattern, group)(match(pattern)(block))


def joined(pattern: str, sep: str, left: Callable[[Column], Column] = lambda c: c, groups: tuple[int, int] = (1, 2)) -> Callable[[Column], Column]:
    """Two groups of one match with sep between them, '' without a match."""
    a, b = first(pattern, groups[0]), first(pattern, groups[1])
    return lambda block: once(match(pattern)(block), lambda m: F.when(m == "", "").otherwise(F.concat(left(a(m)), F.lit(sep), b(m))))


def address(pattern: str, *rubbish: str) -> Callable[[Column], Column]:
    """A match across lines without the rubbish patterns, on one line."""

    def extract(block: Column) -> Column:
        out = first(pattern, flags=DOTALL)(block)
        for r in rubbish:
            out = F.regexp_replace(out, "(?U)" + r, "")
        return T.squeeze(out)

    return extract


@dataclass(frozen=True)
class Layout:
    """How one issuer's texts become bills. Fields without a rule are '' or 0; split None: one bill a file."""

    issuer: str
    name: str
    split: str | None
    rules: dict[str, Callable[[Column], Column]] = field(hash=False)


# Separators and field patterns of the issuers' texts.
BACK = "AUTENTICAÇ[AÃÂ]O NO VERSO"
MECHANICAL = "Autentica[çc][aã]o Mec[êeâa]nica"
LOTTERY = r"PREFERENCIALMENTE\s+NAS\s+CASAS\s+LOT[ÉE]RICAS\s+AT[ÉE]\s+O\s+VALOR\s+LIMITE"
NAME = r"NOME:\s*(.*?)(?=\s{4,}|$)"
SEWAGE = r"ESGOTO\s+([\d\.,]+)"
WATER = r"FATURAMENTO AGUA\s+([\d\.,]+)"
CONTA = r"Nº Conta:\s*(\d+)"
STUB = r"([\d\.]+)\s+([A-Z]{3}/\d{4})\s+(\d{8,})\s+(\d{2}/\d{2}/\d{4})\s+([\d\.,]+)"
HEADER = r"R\$?\s*([\d\.,]+)\s+(\d{2}/\d{2}/\d{4})\s+([\w/-]+)\s*\n\s*Pagador"
METER = r"Hidrometro:\s*([A-Z0-9]+)"

_IPAMERI = {
    "NUM_FATURA": first(r"FATURA:\s*\d{2}/\d{4}\s*N[º°o]\s*(\d+)"),
    "VENCIMENTO": first(r"VENCIMENTO:\s*(\d{2}/\d{2}/\d{4})"),
    "CONTA_DV": joined(r"MATR[ÍI]CULA:\s*(\d+)\s*D[ÍI]GITO:\s*(\d+)", "-"),
    "MES_ANO_REF": first(r"M[êe]s/Ano Faturamento:\s*(\d{2}/\d{4})"),
    "NOME_CLIENTE": stripped(NAME),
    "CONSUMO_M3": first(r"Consumo Faturado:\s*([\d\.,]+)"),
    "VALOR_AGUA": first(WATER),
    "VALOR_ESGOTO": first(SEWAGE),
    "VALOR_TOTAL": first(r"VALOR\s*\(R\$\):\s*([\d\.,]+)"),
}
LAYOUTS = [
    Layout("IPAMERI", "IPAMERI", BACK, _IPAMERI),
    Layout("BURITI_ALEGRE", "BURITI_ALEGRE", BACK, {**_IPAMERI, "VALOR_AGUA": first(r"TARIFA AGUA\s*-\s*([\d\.,]+)")}),
    Layout("DEMAE", "DEMAE", BACK, {
        "NUM_FATURA": first(r"Fatura\s*n[º°o]:\s*(\d+)"),
        "VENCIMENTO": first(r"Data\s*de\s*Vencimento:\s*(\d{2}/\d{2}/\d{4})"),
        "CONTA_DV": first(r"Matrícula:\s*([\d-]+)"),
        "MES_ANO_REF": first(r"Referência:\s*(\d{2}/\d{4})"),
        "NOME_CLIENTE": stripped(r"MORADOR:\s*([^\n]+)"),
        "CONSUMO_M3": first(r"\(Atual\).*?Lido\s+\d+\s+([\d\.,]+)"),
        "VALOR_AGUA": first(WATER),
        "VALOR_ESGOTO": first(SEWAGE),
        "VALOR_TOTAL": first(r"TOTAL A PAGAR\s+([\d\.,]+)"),
    }),
    Layout("SAAE_ABADIANIA", "SAAE_ABADIANIA", BACK, {
        "NUM_FATURA": of_match(STUB, 3),
        "VENCIMENTO": of_match(STUB, 4),
        "CONTA_DV": of_match(STUB, 1),
        "MES_ANO_REF": lambda block: once(
            of_match(STUB, 2)(block), lambda m: F.when(m == "", "").otherwise(F.concat(T.month_by_abbreviation(F.substring(m, 1, 3)), F.substring(m, 4, 5)))
        ),
        "NOME_CLIENTE": stripped(r"NOME:\s*(.*?)(?=\s+LOCALIZA[ÇC][AÃ]O|\n)"),
        "CONSUMO_M3": first(r"(?:[A-Z]{3}/\d{2})\s+(\d+)\s+\d{3}\s+\d{2,3}"),
        "VALOR_AGUA": first(r"TARIFA DE [AÁ]GUA.*?\s([\d\.,]+)\s*\n"),
        "VALOR_ESGOTO": first(r"TARIFA DE ESGOTO.*?\s([\d\.,]+)\s*\n"),
        "VALOR_TOTAL": of_match(STUB, 5),
    }),
    Layout("SAAE_CORUMBA", "SAAE_CORUMBA", MECHANICAL, {
        "NUM_FATURA": first(r"N\.\s+(\d+)\s+Parcela"),
        "CONTA_DV": first(CONTA),
        "MES_ANO_REF": joined(r"Referência\s*(\d{1,2})\s*/\s*(\d{4})", "/", T.pad2),
        "NOME_CLIENTE": stripped(NAME),
        "VENCIMENTO": first(r"Vencimento:[^\d]*(\d{2}/\d{2}/\d{4})"),
        "CONSUMO_M3": first(r"Consumo do mês:\s*(\d+)"),
        "VALOR_AGUA": first(r"TARIFA DE [AÁ]GUA\s+([\d\.,]+)"),
        "VALOR_ESGOTO": first(SEWAGE),
        "VALOR_TOTAL": first(r"\(-\)\s*Valor do Pagamento\s*(?:Declara[çc][aã]o:)?\s*R\$\s*([\d\.,]+)"),
    }),
    Layout("SAAE_MINEIROS", "SAAE_MINEIROS", MECHANICAL, {
        "NUM_FATURA": first(r"N\.\s*(?:Duam:)?\s*(\d+)"),
        "CONTA_DV": first(CONTA),
        "MES_ANO_REF": joined(r"Referência:\s*(\d{1,2})\s*/\s*(\d{4})", "/", T.pad2),
        "NOME_CLIENTE": stripped(NAME),
        "VENCIMENTO": first(r"Vencimento:\s*(\d{2}/\d{2}/\d{4})"),
        "CONSUMO_M3": first(r"Consumo do m[êe]s:\s*(\d+)"),
        "VALOR_AGUA": first(r"CAPTACAO\s*E\s*DIST\.\s*AGUA\s+([\d\.,]+)"),
        "VALOR_ESGOTO": first(r"COLETA\s*E\s*AFASTAMENTO\s*DE\s*ESG\s+([\d\.,]+)"),
        "VALOR_TOTAL": first(r"\(-\)\s*Valor do Pagamento\s*R\$\s*([\d\.,]+)"),
    }),
    Layout("CODEGO", "CODEGO", LOTTERY, {
        "NUM_FATURA": of_match(HEADER, 3),
        "VENCIMENTO": of_match(HEADER, 2),
        "CONTA_DV": first(METER),  # the issuer prints no other account
        "MES_ANO_REF": joined(r"Hidrometro:[^\n]*\n\s*(\p{L}+)/(\d{4})", "/", T.month_by_name),
        "NOME_CLIENTE": stripped(r"Pagador\s+(.*?)\s*Código de Baixa"),
        "LOGRADOURO": address(r"Pagador[^\n]*\n(.*?CEP:.*?-\s*[A-Z]{2}\b)", r"\d{15,}"),
        "CONSUMO_M3": first(r"Consumo:\s*M[³3]\s*([\d\.,]+)"),
        "VALOR_AGUA": first(r"Agua:\s*([\d\.,]+)"),
        "VALOR_ESGOTO": first(r"Coleta/Esgoto:\s*([\d\.,]+)"),
        "VALOR_TOTAL": of_match(HEADER, 1),
    }),
    Layout("SAE", "SAE CATALÃO", None, {
        "MES_ANO_REF": first(r"M[êe]s/Ano Faturamento:?\s*(\d{2}/\d{4})"),
        "NUM_FATURA": first(r"\bFATURA\b[^\d]*(\d{5,})"),
        "VENCIMENTO": first(r"Vencimento.*?Valor.*?(\d{2}/\d{2}/\d{4})", flags=DOTALL),
        "CONTA_DV": joined(r"Matr[íi]cula[^\d]*(\d{4,})\s*[-/]?\s*(\d{1,2})", " "),
        "NOME_CLIENTE": stripped(r"([^\n]+)\s*VIA DO CONTRIBUINTE"),
        "LOGRADOURO": address(r"VIA DO CONTRIBUINTE\s*(.*?CEP:?\s*\d{5}-\d{3})", r"^\s*\(\d+\)\s*"),
        "CONSUMO_M3": first(r"Consumo Faturado:\s*(\d+)"),
        "VALOR_AGUA": first(r"FATURAMENTO AGUA\s*-\s*([\d\.,]+)"),
        "VALOR_ESGOTO": first(r"FATURAMENTO ESGOTO\s*-\s*([\d\.,]+)"),
        "VALOR_TOTAL": first(r"TOTAL A PAGAR\s*([\d\.,]+)"),
    }),
]
