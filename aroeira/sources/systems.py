"""The shipped systems: remote folders, naming, criteria, parsers; code tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import parsing
from ..functions.criteria import CriteriaSet, StringCriteria
from .naming import CountryYear, NamingStrategy, StatePeriod, StateYear

# States and their codes.
STATES = {
    "DF": "53", "RJ": "33", "SP": "35", "AC": "12", "AL": "27", "AM": "13", "AP": "16", "BA": "29", "CE": "23", "ES": "32", "GO": "52", "MA": "21", "MG": "31", "MS": "50",
    "MT": "51", "PA": "15", "PB": "25", "PE": "26", "PI": "22", "PR": "41", "RN": "24", "RO": "11", "RR": "14", "RS": "43", "SC": "42", "SE": "28", "TO": "17",
}

# File families of each system.
SIA_SOURCES = ("AB", "ABO", "ACF", "AD", "AM", "AN", "AQ", "AR", "ATD", "PA", "PS", "SAD", "BI")
SIH_SOURCES = ("ER", "RD", "RJ", "SP")
SIM_SOURCES = ("DO", "DOEXT", "DOFET", "DOINF", "DOMAT", "DOREXT")
SINAN_SOURCES = (
    "ACBI", "ACGR", "AIDA", "AIDC", "ANIM", "ANTR", "BOTU", "CANC", "CHAG", "CHIK", "COLE", "COQU", "DCRJ", "DENG", "DERM", "DIFT", "ESPO", "ESQU", "EXAN", "FMAC",
    "FTIF", "HANS", "HANT", "HEPA", "HIVA", "HIVC", "HIVE", "HIVG", "IEXO", "INFL", "LEIV", "LEPT", "LERD", "LTAN", "MALA", "MENI", "MENT", "NTRA", "PAIR", "PEST",
    "PFAN", "PNEU", "RAIV", "ROTA", "SDTA", "SIFA", "SIFC", "SIFG", "SRC", "TETA", "TETN", "TOXC", "TOXG", "TRAC", "TUBE", "VARC", "VIOL", "ZIKA",
)

# Dental occupations and procedures used as value sets of filters.
CBO = {
    "dentista_auditor": "223204", "dentista_clinico_geral": "223208", "dentista_dentistica": "223280", "dentista_dtm": "223284", "dentista_endodontista": "223212",
    "dentista_epidemiologista": "223216", "dentista_estomatologista": "223220", "dentista_implantologista": "223224", "dentista_odontogeriatra": "223228",
    "dentista_odontologia_do_trabalho": "223276", "dentista_pacientes_especiais": "223288", "dentista_odonto_legal": "223232", "dentista_odontopediatra": "223236",
    "dentista_orto": "223240", "dentista_patologista": "223244", "dentista_periodontista": "223248", "dentista_protese_buco": "223252", "dentista_protesista": "223256",
    "dentista_radiologista": "223260", "dentista_reabilitacao": "223264", "dentista_bucomaxilofacial": "223268", "dentista_saude_coletiva": "223272",
    "dentista_saude_da_familia": "223293",
}
SIGTAP = {"exodontia_de_dente_permanente": "0414020138", "exodontia_multipla_com_alveoloplastia_com_sextante": "0414020146"}


@dataclass(frozen=True)
class System:
    name: str
    path: str
    strategy: NamingStrategy
    sources: tuple[str, ...]
    criteria: CriteriaSet
    parser: Callable[[DataFrame], DataFrame]
    concurrency: int


SYSTEMS = {
    s.name: s
    for s in (
        System("sia", "/dissemin/publicos/SIASUS/200801_/Dados/", StatePeriod(), SIA_SOURCES, CriteriaSet.set([StringCriteria("2270196", "PA_CODUNI")]), parsing.outpatient, 6),
        System("sih", "/dissemin/publicos/SIHSUS/200801_/Dados/", StatePeriod(), SIH_SOURCES, CriteriaSet.set([StringCriteria("2270196", "CNES")]), parsing.dictionary({}), 4),
        System("sim", "/dissemin/publicos/SIM/CID10/DORES/", StateYear(), SIM_SOURCES, CriteriaSet(), parsing.dictionary({}), 4),
        System("sinan", "/dissemin/publicos/SINAN/DADOS/PRELIM/", CountryYear(), SINAN_SOURCES, CriteriaSet.set([StringCriteria("33", "SG_UF_NOT")]), parsing.dictionary({}), 4),
    )
}


def states(spark: SparkSession) -> DataFrame:
    """(uf, code): the 27 states."""
    return spark.createDataFrame(sorted(STATES.items()), "uf string, code string")
