"""Part of formloom; see README.md."""
