"""Training-data operators: quality, duplicates, decontamination, personal data, packing, languages, secrets, licences."""
