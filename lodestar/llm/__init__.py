"""Operations of a training-data pipeline: search, packing, chat formatting, WARC,
sharding, language identification, similarity join, toxicity, token files, benchmark
decontamination, collocations, line dedup and spelling variants. Nothing outside this
subpackage imports it."""
