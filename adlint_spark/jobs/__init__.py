"""The registered jobs over the derived corpus, each with the SQL that tells its result from the keys."""
