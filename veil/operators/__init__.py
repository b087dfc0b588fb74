"""The anonymization operators as plain ``DataFrame -> DataFrame`` functions (usable with
``df.transform``), plus the fitting jobs they need: pseudonyms, generalize, perturb, mask,
the precision/privacy metric and column statistics."""
