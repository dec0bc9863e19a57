"""The queries of this package and their SQL."""

from clinloom.llm import decontam, kneser_ney, langid, line_dedup, merkle, minhash, packing, periodic, suffix_dedup, topk, transducer, url_filter, wavelet

_MODULES = (decontam, kneser_ney, langid, line_dedup, merkle, minhash, packing, periodic, suffix_dedup, topk, transducer, url_filter, wavelet)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
