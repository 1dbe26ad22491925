"""Readers: landed mail, validated observation batches, pasted lists, HTML rows, sheets
and rules, each as a DataFrame with what is invalid set apart."""
