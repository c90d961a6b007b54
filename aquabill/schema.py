"""Fixed schemas. Missing text is null inside and '' at the output boundary."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

_TYPES = {"string": StringType(), "double": DoubleType(), "long": LongType(), "boolean": BooleanType()}


def _struct(fields: str) -> StructType:
    """As StructType.fromDDL, but without a session."""
    out = StructType()
    for f in fields.split(","):
        name, kind = f.split()
        out = out.add(name, _TYPES[kind])
    return out


#: Scanned documents also have root, the name of the folder that was scanned.
DOC = _struct("path string, file_name string, dir string, content string")
BILL = _struct(
    "CONCESSIONARIA string, NUM_FATURA string, MES_ANO_REF string, VENCIMENTO string, COD_ORGAO_AGRUPADOR string, "
    "COD_ORGAO_PAGADOR string, NOME_ORGAO_AGRUPADOR string, CONTA_DV string, NUM_HIDROMETRO string, NOME_CLIENTE string, "
    "LOGRADOURO string, CONSUMO_M3 double, VALOR_AGUA double, VALOR_ESGOTO double, BASE_CALCULO double, "
    "VALOR_TAXAS_EXTRAS double, VALOR_TOTAL double, DATA_PROCESSAMENTO string, ARQUIVO_ORIGEM string, PASTA_ORIGEM string, EMPRESA string"
)
METER = _struct("CONTA_DV string, MES_ANO_REF string, NUM_HIDROMETRO_EXTRAIDO string, ARQUIVO_ORIGEM string, PASTA_ORIGEM string")
#: Stored meter rows also keep their place, which decides ties.
METER_ROW = StructType([*METER.fields, *DOC.fields[:1]]).add("line_no", IntegerType())
#: Columns of the account register, with the other spelling that is read too.
REGISTER = _struct(
    "id_CONTA long, id_UJ long, id_ORDEM long, CONTA_DV string, CONTA long, UNIDADE string, ENDERECO string, "
    "DISTRIBUIDORA string, OPERANTE boolean, AGUA boolean, ESGOTO boolean, SMRSU boolean"
)
REGISTER_ALIASES = {"UNIDADE": "UNIDADE JUDICIÁRIA", "ENDERECO": "ENDEREÇO", "OPERANTE": "OPERANTE - FILTRO"}
#: What the store holds: bills with their account's columns of the register, null without one.
STORED = StructType([*BILL.fields, *[f for f in REGISTER.fields if f.name != "CONTA_DV"]])
#: What makes a bill known to the store; issuers number their bills by themselves.
KEYS = ["EMPRESA", "NUM_FATURA", "MES_ANO_REF", "CONTA_DV"]
