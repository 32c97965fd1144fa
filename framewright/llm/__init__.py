"""Training-data operators: media, mixing, extraction, quality, licences, language models,
decontamination, near duplicates, chat and sharding. Nothing else in the library imports this."""
