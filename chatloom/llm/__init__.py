"""Preparation of texts for training and evaluating language models."""
