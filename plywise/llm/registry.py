"""The queries of this subpackage, by name. The others' hashes, models and parsers are not SQL's."""

from __future__ import annotations

from plywise.llm.common import Query
from plywise.llm.extraction import op3_extraction
from plywise.llm.jaccard import OP11_SQL, op11_jaccard
from plywise.llm.linkgraph import op4_linkgraph
from plywise.llm.mixing import op6_mixing
from plywise.llm.packing import op8_packing
from plywise.llm.parsing import op7_parsing
from plywise.llm.quality import op2_quality
from plywise.llm.sharding import op9_sharding
from plywise.llm.simhash import op1_simhash
from plywise.llm.spelling import OP13_SQL, op13_spelling
from plywise.llm.suffixes import op10_suffixes
from plywise.llm.toxicity import op5_toxicity
from plywise.llm.trie import OP12_SQL, op12_trie

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash, op2_quality, op3_extraction, op4_linkgraph, op5_toxicity, op6_mixing, op7_parsing, op8_packing, op9_sharding, op10_suffixes,
    op11_jaccard, op12_trie, op13_spelling,
)}
ORACLE_SQL: dict[str, str] = {"op11_jaccard": OP11_SQL, "op12_trie": OP12_SQL, "op13_spelling": OP13_SQL}
